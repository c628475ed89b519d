"""Near duplicates by SimHash fingerprints and vantage-point shards.

Fingerprints are partitioned by their Hamming distance from vantage points.
At a node with vantage point v and bound mu, fingerprints within mu of v go
left and the others right; a fingerprint within the search radius of the bound
also goes to the other side, as a query, since the triangle inequality admits
partners there and nowhere else.  A leaf is a shard: one task finds the exact
pairs of it and gives them back as stars, never as all pairs of a group.

Two trees are used, each over one half of the bits: two fingerprints within r
bits are within r // 2 in one of the halves, so a tree needs only that smaller
radius.  A shard that comes out large, of more fingerprints than the sample of
the trees could part or of many that share one half, is parted again where it
lies, by a tree of its own over all bits.

Equal fingerprints are joined first and count as one.  Stars meet in rounds of
contraction with pointer jumping over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .arrays import mix
from .common import remove_path, written

SEED = 42
#: Fingerprints that trees are fitted on: all up to SAMPLE, then one of each SHARE by their hashes, about MOST at most; all are indexed.
SAMPLE, SHARE, MOST = 20_000, 100, 4_000_000
#: Fingerprints of a shard, about.
SHARD = 2_000


# ---------------------------------------------------------------- fingerprints


def _shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words, repeats included; fewer words are one run."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and white space from 9 to 13 and 32
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, n = [0, *ends[:-1].tolist()], min(n, len(words))
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def _majorities(hashes: np.ndarray, longs: int) -> bytes:
    """``longs`` fingerprints behind each other: of the hashes themselves, then of further hashes made from them."""
    if not len(hashes):
        return bytes(8 * longs)
    with np.errstate(over="ignore"):
        odd = np.arange(longs, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        on = np.zeros(64 * longs, dtype=np.int64)
        for start in range(0, len(hashes), 255):  # so many bits add up within a byte
            part = hashes[start : start + 255]
            many = mix(part[:, None] + odd)
            many[:, 0] = part
            bits = np.unpackbits(np.ascontiguousarray(many, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
            on += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * on > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a signed long).

    A null text has no words; no words give zero.  Every row gives one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([_majority(_shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(make, "doc_id long, fp long")


# ------------------------------------------------------------ vantage-point trees


def _apart(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


class VantageTree:
    """A tree over the bits under ``mask`` for searches within ``radius`` there."""

    def __init__(self, sample: np.ndarray, scale: float, mask: int, radius: int, shard: int = SHARD):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple] = []  # (vantage point, bound, left, right), a leaf is its number alone
        self.leaves = 0
        self.root = self._grow(sample, scale, shard)

    def _grow(self, sample: np.ndarray, scale: float, shard: int):
        if len(sample) * scale > shard:
            best = None
            for v in sample[:: max(1, len(sample) // 6)][:6]:
                apart = _apart(sample, v, self.mask)
                bound = int(np.median(apart))
                left = apart <= bound
                near = (np.abs(apart - bound) <= self.radius).mean()
                if 0 < left.sum() < len(sample) and (best is None or near < best[0]):
                    best = near, v, bound, left
            if best:
                _, v, bound, left = best
                at = len(self.nodes)
                self.nodes.append(())
                self.nodes[at] = (v, bound, self._grow(sample[left], scale, shard), self._grow(sample[~left], scale, shard))
                return at
        self.leaves += 1
        return ~(self.leaves - 1)  # leaves are negative

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, index into ``fps``, at home there) for each shard that a fingerprint goes to."""
        leaf, index, home = [], [], []
        stack = [(self.root, np.arange(len(fps)), np.zeros(0, dtype=np.int64))]
        while stack:
            node, own, asks = stack.pop()
            if not len(own) and not len(asks):
                continue
            if node < 0:
                leaf.append(np.full(len(own) + len(asks), ~node))
                index += [own, asks]
                home.append(np.arange(len(own) + len(asks)) < len(own))
                continue
            v, bound, left, right = self.nodes[node]
            d, q = _apart(fps[own], v, self.mask), _apart(fps[asks], v, self.mask)
            here = d <= bound
            # a pair that is parted here is found by its left one, which asks on the right
            stack.append((left, own[here], asks[q - self.radius <= bound]))
            stack.append((right, own[~here], np.concatenate((own[here & (d + self.radius > bound)], asks[q + self.radius > bound]))))
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        return cat(leaf, np.int64), cat(index, np.int64), cat(home, bool)


def _near(own: np.ndarray, asks: np.ndarray, size_own, size_asks, limits: list[tuple[int, int]], ratio: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in own, index in asks), in bounded blocks; of ``same`` arrays each pair once.

    ``limits`` has (longs, bits): a pair differs in that many bits of the first
    longs at most.  The first limit is tried on all pairs, others on what is left.
    """
    step, (longs, most) = 1024, limits[0]
    for a in range(0, len(own), step):
        for b in range(a if same else 0, len(asks), step):
            apart = sum(np.bitwise_count(own[a : a + step, None, w] ^ asks[None, b : b + step, w]) for w in range(longs))
            x, y = np.nonzero(apart <= most)
            x, y = x + a, y + b
            ok = x < y if same else np.ones(len(x), dtype=bool)
            if size_own is not None and len(x):
                m, n = size_own[x], size_asks[y]
                ok &= np.minimum(m, n) >= ratio * np.maximum(m, n) - 1e-6
            x, y = x[ok], y[ok]
            for more, bits in limits[1:]:
                found = np.zeros(len(x), dtype=np.int64)
                for w in range(more):
                    found += np.bitwise_count(own[x, w] ^ asks[y, w])
                x, y = x[found <= bits], y[found <= bits]
            if len(x):
                yield x, y


def _root(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = label[x]
        if (y == x).all():
            return x
        x = y


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = _root(label, a), _root(label, b)
        if not (open_ := ra != rb).any():
            return
        np.minimum.at(label, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])


def _linked(label: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
    top = _root(label, np.arange(len(label)))
    linked = np.flatnonzero(top != np.arange(len(label)))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[top[linked]]})


def _unite_near(label: np.ndarray, fps: np.ndarray, own: np.ndarray, asks: np.ndarray, radius: int) -> None:
    """Unite those of ``own`` that are near each other or near one of ``asks`` (indices into ``fps``)."""
    for right, same in ((own, True), (asks, False)):
        for x, y in _near(fps[own, None], fps[right, None], None, None, [(1, radius)], 0.0, same):
            _unite(label, own[x], right[y])


def _shard_links(fps: np.ndarray, home: np.ndarray, radius: int, shard: int = SHARD) -> pd.DataFrame:
    """Links of one shard, as (member, least member of its class here).

    Those at home are compared with each other and with those that ask.  More
    than twice ``shard`` of them are parted by a tree over all bits first.
    """
    label = np.arange(len(fps))
    if len(fps) <= 2 * shard:
        _unite_near(label, fps, np.flatnonzero(home), np.flatnonzero(~home), radius)
    else:
        sample = fps[np.argsort(mix(fps))[:SAMPLE]]
        leaf, index, own = VantageTree(sample, len(fps) / len(sample), (1 << 64) - 1, radius, shard).deal(fps)
        order = np.argsort(leaf, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            at, here = index[part], own[part]
            _unite_near(label, fps, at[here], at[~here], radius)
    return _linked(label, fps.view(np.int64))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[np.ndarray]:
    """The fingerprints of batches, about ``rows`` at a time: a tree's nodes are visited once for each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(held[-1])
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column ``fp`` at most ``radius`` bits apart, as stars."""
    spark, n = prints.sparkSession, prints.count()
    some = prints.select("fp")
    if n > SAMPLE:  # so the number of shards grows with the fingerprints, up to billions
        wanted = min(MOST, max(SAMPLE, n // SHARE))
        some = some.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < (wanted << 32) // n)
    part = some.toArrow().column(0).to_numpy().view(np.uint64)
    sample = part[np.argsort(mix(part))]  # a fixed order without structure
    halves = (0xFFFFFFFF, 0xFFFFFFFF << 32)
    forest = spark.sparkContext.broadcast([VantageTree(sample, n / max(1, len(sample)), m, radius // 2) for m in halves])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _gathered(batches):
            base = 0
            for tree in forest.value:
                leaf, index, home = tree.deal(fps)
                yield pa.RecordBatch.from_arrays([pa.array(leaf + base), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])
                base += tree.leaves

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        return _shard_links(rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(), radius)

    shards = prints.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return shards.groupBy("shard").applyInPandas(links, "a long, b long")


# ------------------------------------------------------------------- components


def _moving(df: DataFrame, moves: Column, label: str) -> tuple[DataFrame, int]:
    """``df`` written and read again, and the number of its rows for which ``moves`` holds."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.when(moves, 1)).alias("n")), label)
    return out, seen.get["n"]


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the links (a, b).

    In a round each node points to the least of itself and its neighbours,
    pointers are followed to their roots by doubling, and links are drawn between
    roots; those within a root go.  So links get fewer from round to round (a star
    is gone after two at most) and nodes with a link halve in two.  The least node
    of a component always points to itself.  What a round needs is written to the
    shared folder, so a lost executor costs one round at most.
    """
    spark, rounds, used = links.sparkSession, [], []

    def kept(df: DataFrame, moves: Column, label: str) -> tuple[DataFrame, int]:
        out, n = _moving(df, moves, label)
        used.extend(out.inputFiles()[:1])
        return out, n

    edges, n = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), F.lit(True), "links")
    while n or not rounds:
        both = edges.union(edges.select("b", "a"))
        labels, jumps = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), F.col("node") != F.col("label"), "labels")
        while jumps:
            above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
            jumped = labels.join(above, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved"))
            labels, jumps = kept(jumped, F.col("moved"), "labels")
        labels = labels.select("node", "label")
        rounds.append(labels)
        at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_root"))
        drawn = edges.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root")
        edges, n = kept(drawn.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), F.lit(True), "links")
    found = rounds.pop()
    while rounds:
        above = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
        found = rounds.pop().join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = written(found.select("node", F.col("label").alias("component")), "components")
    for path in used:
        remove_path(spark, path.rsplit("/", 1)[0])
    return out


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of all that links reach).

    Every row gives one, repeated rows too; texts without words have
    fingerprint zero and are linked like any other.  A null id stays null and
    is no component's id unless the component has no other.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(near_links(classes.select("fp"), radius))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
