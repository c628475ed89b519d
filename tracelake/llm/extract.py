"""Main text of HTML pages by paths that the pages of a host agree on.

Each page's containers are scored by the text that stands in their blocks,
without link text and without parts whose tag or class names furniture.  A
container votes for its path of tags and classes, in which numbers are made
alike; Spark adds the votes of a host, and the path with most of them wins.
Parts with a class or id beside or in the container are voted on too, whatever
they are called: one whose text a host repeats on pages that differ, or that is
links on most pages, is furniture of the host.  The pages are then read again,
and the winning path's containers give the text without that furniture; a page
that has none of them gives its own best container.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Container, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .urlfilter import host_and_path

# As HTML has it: a value without quotes may hold quotes, one in quotes may hold
# ">".  A quote that nothing closes is part of a name, and a tag that nothing
# closes takes what follows.  No part is read twice, so the time is linear.
_ATTRIBUTES = r"""(?:[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|[\s/=])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
_READ = {"class", "id", "role", "itemprop"}

_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = set("nav footer aside form head script style noscript template iframe select button svg dialog textarea menu object canvas title".split())
#: Names of furniture, and words that say where or in what it stands.
_NAMES = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: The same in German, French and Spanish.
_NAMES |= set(
    "anzeige anzeigen werbung kommentar kommentare leserkommentare leserbriefe seitenleiste fusszeile fußzeile kopfzeile seitenkopf brotkrumen teilen abonnieren publicite publicité publicites publicités commentaire commentaires partage partager abonnement publicidad anuncio anuncios comentario comentarios compartir suscripcion suscripción migas".split()
)
#: Names of readers' parts only outside of an article or main element: within them they may be a subject.
_OUTSIDE = set("reaction reactions réaction réactions reaktion reaktionen reaccion reacciones responses antworten réponses reponses respuestas opiniones leser lecteurs lectores".split())
_PLACES = set(
    "aside area bar block bottom box button buttons column container content drop fixed foot form global group head holder icons inner item items left link links list main mega mobile outer overlay page panel primary right row secondary section side site slot sticky strip sub tools top unit user web widgets wrap wrapper".split()
)
#: Both in one word, such as "topnav" or "commentlist".
_COMPOUND = re.compile(rf"(?:{'|'.join(sorted(_PLACES))})?(?:{'|'.join(sorted(x for x in _NAMES if len(x) > 2))})(?:{'|'.join(sorted(_PLACES))})?")
#: A class name that begins so says what its element has or lacks, not what it is.
_MODIFIERS = {"has", "with", "without", "no", "is"}
_HEADERS = {"header", "masthead"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "dialog", "alert", "form"}
#: A start tag of the key ends an open element of the values, unless one of the third stands between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "dl", "table", "select", "body"}
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HOMES = {"article": 4, "main": 3}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a host can vote out.
_PARTS = set("address div dl details fieldset figure ol p section table ul".split())
#: A part whose text is links for more than this share is one of links.
_LINKS = 0.8
#: Digests of runs of blocks: polynomials over the blocks' hashes, modulo a prime.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_ALL = (1 << 64) - 1
#: Levels above a block that it counts for; its weight halves at each.
_LEVELS = 60


@functools.lru_cache(1 << 14)
def furniture_names(name: str) -> set[str]:
    """The words of furniture in a class or id name, if it is one's name: "cookie-notice", "share-buttons", but not "social-science"."""
    parts = re.findall(r"[^\W\d_]+", name)
    if not parts or parts[0] in _MODIFIERS:
        return set()
    marks = {x for x in parts if x in _NAMES or _COMPOUND.fullmatch(x)}
    return marks if parts[-1] in marks or all(x in marks or x in _PLACES for x in parts) else set()


@functools.lru_cache(1 << 14)
def _readers_part(name: str) -> bool:
    parts = re.findall(r"[^\W\d_]+", name)
    return bool(parts) and parts[0] not in _MODIFIERS and any(x in _OUTSIDE for x in parts) and all(x in _OUTSIDE or x in _PLACES for x in parts)


class Page:
    """Elements as (parent, tag, path, furniture) and text blocks as (element, text, link characters) in page order.

    A path is a number: a hash of its parent's number and of the element's
    generalised tag and classes, so deep nesting costs no more than flat.  What
    a host can vote out has a second number, in which its id counts too; all
    blocks inside an element are a run, from ``first`` to ``last``.
    """

    def __init__(self, html: str | None):
        self.parent, self.tag, self.path, self.out = [-1], [""], [0], [False]
        self.part, self.first, self.last = [0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._open, self._text, self._links, self._in_link = [0], [], 0, 0
        self._count: dict[str, int] = {}  # open elements by tag
        html, at = html or "", 0
        while m := _TOKEN.match(html, at):
            at = m.end()
            tag = m[2]
            if tag is None:
                if html[m.start()] != "<" or m.end() - m.start() == 1:
                    self._text.append(m[0])
                    self._links += len(m[0]) * (self._in_link > 0)
                continue
            if html[at - 1] != ">":  # the page ends within the tag
                break
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in _RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    self._end(tag)
        self._pop_to(0)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text and not self.out[self._open[-1]]:
                self.blocks.append((self._open[-1], text, self._links))
            self._text, self._links = [], 0

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for x in self._open[depth:]:
            self._count[self.tag[x]] = self._count.get(self.tag[x], 0) - 1
            self.last[x] = len(self.blocks)
        del self._open[depth:]

    def _start(self, tag: str, attributes: str) -> None:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            if (name := m[1].lower()) in _READ:
                found.setdefault(name, (m[2] or m[3] or m[4] or "").lower())
        shown = found.get("class", "").split()
        names = shown if tag in _HEADINGS else [*shown, found.get("id", "")]  # a heading's id is an anchor
        named = set().union(*map(furniture_names, names)) if found else set()
        marked = bool(named) or found.get("role") in _ROLES
        if tag in _INLINE and not marked:
            self._in_link += tag == "a"
            return
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._flush()
            return
        self._flush()
        if tag in _CLOSES_P and self._count.get("p"):
            depth = len(self._open) - 1
            while self.tag[self._open[depth]] != "p":
                depth -= 1
            self._pop_to(depth)
        if tag in _ENDS and any(self._count.get(x) for x in _ENDS[tag]):
            for depth in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[depth]] in _ENDS[tag]:
                    self._pop_to(depth)
                elif self.tag[self._open[depth]] in _HOLDS:
                    break
        above = self._open[-1]
        inside = any(self._count.get(x) for x in _HOMES)
        home = tag in _HOMES or tag in ("html", "body") or found.get("itemprop") == "articlebody"
        if home:  # a class of a main element counts only if it is a name of furniture as a whole
            marked = tag in _HOMES and bool(set(shown) & (_NAMES - _HEADERS))
        elif inside and named and named <= _HEADERS:
            marked = False
        elif not inside and any(map(_readers_part, names)):
            marked = True
        furniture = tag in _FURNITURE or tag == "header" and not inside or marked
        shape = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in shown)])
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass"), self.path[above]))
        self.out.append(self.out[above] or furniture)
        part = tag in _PARTS and not home and (shown or found.get("id"))
        self.part.append(xxhash.xxh64_intdigest(re.sub(r"\d+", "#", found.get("id", "")).encode("utf-8", "surrogatepass"), self.path[-1]) if part else 0)
        self.first.append(len(self.blocks))
        self.last.append(-1)
        self._open.append(len(self.tag) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._flush()
        if self._count.get(tag):
            if tag not in ("html", "body"):  # what follows them still belongs to the body
                depth = len(self._open) - 1
                while self.tag[self._open[depth]] != tag:
                    depth -= 1
                self._pop_to(depth)
        elif tag == "a":
            self._in_link = max(0, self._in_link - 1)

    def scores(self) -> dict[int, float]:
        """Containers: a block counts for its element's parent, and half as much for each one above."""
        found: dict[int, float] = {}
        for element, text, links in self.blocks:
            at = element if self.tag[element] not in ("p", "pre", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "") else self.parent[element]
            weight = max(0, len(text) - 2 * links) + 0.01
            for _ in range(_LEVELS):
                if at <= 0:
                    break
                found[at] = found.get(at, 0.0) + weight * _HOMES.get(self.tag[at], 1)
                at, weight = self.parent[at], weight / 2
        return found

    def best(self) -> int:
        """Element of the best container, 0 (the page) if there is none; of equals the first."""
        found = self.scores()
        return max(found, key=lambda x: (found[x], -x)) if found else 0

    def parts(self) -> tuple[int, dict[int, tuple[int, bool]]]:
        """A digest of the page, and one of each part that holds text with whether it is links; not of what holds the best container."""
        digest, power, chars, links = [0], [1], [0], [0]
        for _, text, linked in self.blocks:
            digest.append((digest[-1] * _BASE + xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))) % _PRIME)
            power.append(power[-1] * _BASE % _PRIME)
            chars.append(chars[-1] + len(text))
            links.append(links[-1] + min(linked, len(text)))
        holds, at = set(), self.best()
        while at > 0:
            holds.add(at)
            at = self.parent[at]
        found: dict[int, tuple[int, int, int]] = {}
        for x, part in enumerate(self.part):
            a, b = self.first[x], self.last[x]
            if part and a < b and x not in holds:
                run = (digest[b] - digest[a] * power[b - a]) % _PRIME
                d, c, n = found.get(part, (0, 0, 0))
                found[part] = (d * _BASE + run) % _PRIME, c + chars[b] - chars[a], n + links[b] - links[a]
        return digest[-1], {p: (d, n > _LINKS * c) for p, (d, c, n) in found.items()}

    def text(self, path: int | None, furniture: Container[int] = ()) -> str:
        """Blocks inside the path's containers, or inside the page's best one, but not in the host's furniture."""
        if path is not None:
            chosen = {x for x, p in enumerate(self.path) if p == path and not self.out[x]}
            found = self._within(chosen, furniture)
            if found or furniture and self._within(chosen, ()):
                return " ".join(found)
        return " ".join(self._within({self.best()}, furniture))

    def _within(self, chosen: set[int], furniture: Container[int]) -> list[str]:
        inside = []
        for x, above in enumerate(self.parent):  # parents stand before their children
            inside.append(x in chosen or above >= 0 and inside[above] and not (self.part[x] and self.part[x] in furniture))
        return [t for e, t, _ in self.blocks if inside[e]]


def _signed(number: int) -> int:
    return number - (number >> 63 << 64)


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, the path (a number) with most votes, of equal ones the greatest, and furniture: the parts voted out, or null.

    Of k different pages of a host with a part it is furniture if they have d
    texts for it with 2 d + sqrt(k) <= k, or if it is links on m of them with
    2 m > k + sqrt(k): the bounds of a majority, which few pages never reach.
    Copies of a page count once, so copies of an article do not make it
    furniture.  Pages without a host do not vote.
    """
    rows = pages.select(host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html")).where("host <> ''")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int], int] = {}
            seen: set[tuple[str, int, int, int, bool]] = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html)
                found = page.scores()
                top = max(found.values(), default=1)
                for x, score in found.items():
                    key = host, _signed(page.path[x])
                    votes[key] = votes.get(key, 0) + round(1000 * score / top)
                whole, parts = page.parts()
                seen.update((host, _signed(p), whole, d, links) for p, (d, links) in parts.items())
            out = [(h, p, n, None, None, None) for (h, p), n in votes.items()] + [(h, p, None, w, d, k) for h, p, w, d, k in seen]
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["host", "path", "votes", "page", "digest", "links"])

    told = written(rows.mapInArrow(vote, "host string, path long, votes long, page long, digest long, links boolean"), "votes")
    votes = told.where("votes is not null").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))
    # Pages, then texts: no group holds the pages of a host.
    pages_of = told.where("page is not null").groupBy("host", "path", "page").agg(F.max("digest").alias("digest"), F.bool_or("links").alias("links"))
    texts = pages_of.groupBy("host", "path", "digest").agg(F.count("*").alias("pages"), F.count_if("links").alias("links"))
    parts = texts.groupBy("host", "path").agg(F.sum("pages").alias("k"), F.count("*").alias("d"), F.sum("links").alias("m"))
    out = parts.where("2 * d + sqrt(k) <= k or 2 * m > k + sqrt(k)").groupBy("host").agg(F.collect_list("path").alias("furniture"))
    return best.join(out, "host", "left")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has an empty text; a page without a host is read by
    its own best container, with no furniture but by names; null ids stay null
    and repeated rows each give one.  A page of nothing but furniture is empty.
    Time and memory of a page are linear in its length, however deep its
    elements nest and whatever quotes or tags stay open: a quote that nothing
    closes ends with its tag, a tag that nothing closes takes the rest.
    """
    paths = written(host_paths(pages, url_col=url_col, html_col=html_col), "paths")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_and_path(F.col(url_col))[0].alias("host"))
    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path", "furniture")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, path, out in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                texts.append(Page(html).text(None if path is None else path & _ALL, {p & _ALL for p in out or ()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(joined.dtypes)["page_id"]
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
