"""Drop near duplicates: texts whose distinct word shingles have a wanted Jaccard similarity.

The vantage-point trees of ``simhash`` link SimHash fingerprints of 64 bits that
differ in ``RADIUS`` at most.  At a similarity of 0.8 they differ in about ten,
while those of unrelated texts differ in 32 +- 4: vantage points prune nothing
there, as every ball meets every bound.  So that no such pair is lost, further
shards are dealt by least shingle hashes: a key is made of the least values of
``ROWS`` hash functions, and a text has ``KEYS`` keys.  A pair of similarity 0.8
has no common key with a probability of 2e-5, and a text sends ``KEYS`` rows
whatever the corpus.

1. Vantage-point trees over the fingerprints give links, as stars.
2. Further candidates.  In each shard of least hashes all fingerprints are
   compared with that of one member; those that are near are linked with it.
   What neither this nor the trees have linked with it is then compared with the
   whole shard, block by block, so that nothing is lost.
3. Exact classes.  Only candidates' sets of shingles are shuffled.  A small
   component is compared at once.  A large one is dealt to chunks; each chunk
   names the member with most links, and these hubs are vantage points for all
   chunks: texts linked with the same hub need not be compared.  What is left
   outside the component's largest class is then compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import memory
from .arrays import mix, shingle_sets
from .common import Tables, set_aside, small
from .simhash import SEED, _linked, _majorities, _near, _unite, components, near_links

#: Keys of a text and hash functions behind a key.
KEYS, ROWS = 16, 3
#: Bits of 64 that the trees' links differ in at most: one in one of the halves, so three cost what two do.
RADIUS = 3
#: Longs of a fingerprint, and bits that candidates differ in at most.  A bit
#: differs with a probability of 0.1875 at most between texts of similarity 0.8
#: (reached by four and five shingles), so such a pair is missed with 8e-7.
LONGS, BITS = 4, 80
#: Rows of a shard, and texts and shingles of a component, that a task compares at once.
BLOCK, CHUNK, WEIGHT = 1_024, 512, 1 << 18
#: Rows left over of small shards, and shingles of small components, that share a task, about.
SHARE, BUCKET = 500, 1 << 16
#: Members of a large component that all of its chunks are compared with.
HUBS = 32
#: Columns of an incidence matrix at a time.
COLUMNS = 1_024
#: Rows of a few longs that are broadcast, and bits of the filter that goes before texts are hashed.
BROADCAST_ROWS, FILTER_BITS = 500_000, 1 << 26

_ODD = mix(np.arange(1, KEYS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BITS = [f"f{k}" for k in range(LONGS)]


# -------------------------------------------------------------------- sketches


def _keys(hashes: np.ndarray) -> np.ndarray:
    """``KEYS`` keys of a set of hashes, none for an empty one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(_ODD), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 4_096):
            least = np.minimum(least, (hashes[start : start + 4_096, None] * _ODD).min(axis=0))
        key = np.arange(KEYS, dtype=np.uint64)
        for part in least.reshape(KEYS, ROWS).T:
            key = mix(key + part)
    return key.view(np.int64)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """__row, __id, node (a hash of the set of shingles), the fingerprint f0 to f3, n_shingles and keys, of rows with __row, __id and text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        memory.release()
        for batch in batches:
            nodes, bits, sizes, keys = [], [], [], []
            for hashes in shingle_sets(batch.column(2).to_pylist(), words):
                nodes.append(h(hashes.astype("<u8").tobytes(), SEED))
                bits.append(_majorities(hashes, LONGS))
                sizes.append(len(hashes))
                keys.append(_keys(hashes))
            bits = np.frombuffer(b"".join(bits), dtype="<i8").reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), *(pa.array(bits[:, k].copy()) for k in range(LONGS)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["__row", "__id", "node", *_BITS, "n_shingles", "keys"],
            )

    kind = dict(rows.dtypes)["__id"]
    return rows.select("__row", "__id", "text").mapInArrow(make, f"__row long, __id {kind}, node long, {', '.join(f'{c} long' for c in _BITS)}, n_shingles long, keys array<long>")


# ------------------------------------------------------------------ candidates


def _fits(similarity: float) -> Column:
    """Whether a row and its shard's ``pivot`` may have the similarity."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"pivot.{c}"))) for c in _BITS[1:]), F.bit_count(F.col("f0").bitwiseXOR(F.col("pivot.f0"))))
    m, n = F.col("n_shingles"), F.col("pivot.n_shingles")
    return (apart <= BITS) & (F.least(m, n) >= F.lit(similarity) * F.greatest(m, n) - 1e-6)


def _block_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the members and the guests of each shard of a task; ``label`` tells those that are linked already."""
    rows = rows.sort_values("key", kind="stable")
    fps, sizes, home, label = rows[_BITS].to_numpy().view(np.uint64), rows["n_shingles"].to_numpy(), rows["home"].to_numpy(), rows["label"].to_numpy()
    found = np.arange(len(rows))
    edges = np.flatnonzero(np.diff(rows["key"].to_numpy())) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)]):
        own, asks = np.flatnonzero(home[a:b]) + a, np.flatnonzero(~home[a:b]) + a
        if len(own) and len(asks):
            for x, y in _near(fps[own], fps[asks], sizes[own], sizes[asks], [(LONGS, BITS)], similarity, False):
                x, y = own[x], asks[y]
                new = label[x] != label[y]
                _unite(found, x[new], y[new])
    return _linked(found, rows["node"].to_numpy())


def tree_links(nodes: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) between nodes whose first 64 bits differ in ``RADIUS`` at most, by vantage-point trees, as stars."""
    classes = tables.written(nodes.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("first"), F.count("*").alias("n")), "classes")
    near = tables.written(near_links(classes.select("fp"), RADIUS), "near")
    end = lambda name: classes.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_first"))
    apart = near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = nodes.join(classes.where("n > 1").select(F.col("fp").alias("f0"), "first"), "f0").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return tables.written(apart.union(same).distinct(), "trees")


def candidate_links(nodes: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """Links (a, b) whose components hold those of the trees and every pair of nodes with a common key that fingerprints and sizes admit."""
    trees = tree_links(nodes, tables)
    rows = nodes.select("node", *_BITS, "n_shingles", F.explode("keys").alias("key"))
    # the least member: shards of one group mostly share it, so a member has few different links
    pivots = rows.select("key", "node").groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n > 1")
    pivots = tables.written(pivots, "pivots")
    n_shards = pivots.count()
    shards = small(pivots, n_shards, BROADCAST_ROWS).join(nodes.select("node", *_BITS, "n_shingles"), "node")
    shards = tables.written(shards.select("key", "n", F.struct("node", *_BITS, "n_shingles").alias("pivot")), "shards")
    met = rows.join(small(shards, n_shards, BROADCAST_ROWS), "key")
    stars = met.where((F.col("node") != F.col("pivot.node")) & _fits(similarity)).select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
    stars = tables.written(stars.union(trees).distinct(), "stars")
    labels = tables.written(components(stars), "labels").withColumnRenamed("component", "label")
    met = met.where("n > 2").select("key", "n", "node", *_BITS, "n_shingles", F.col("pivot.node").alias("pivot"))
    named = met.join(labels, "node", "left").join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("main")), "pivot", "left")
    named = tables.written(named.select("key", "n", "node", *_BITS, "n_shingles", F.coalesce("label", "node").alias("label"), F.coalesce("main", "pivot").alias("main")), "named")
    rest = F.col("label") != F.col("main")
    open_ = named.where(rest).groupBy("key").agg(F.count("*").alias("n_rest"))
    open_ = tables.written(open_, "open")
    n = open_.agg(F.count("*"), F.sum("n_rest")).first()
    if not n[0]:
        return stars
    left = named.join(small(open_, n[0], BROADCAST_ROWS), "key")
    deal = left.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("guests", F.ceil(F.col("n_rest") / BLOCK).cast("int"))
    whole = (F.col("blocks") == 1) & (F.col("guests") == 1)
    share = max(1, -(-n[1] // SHARE))
    task = F.when(whole, F.pmod(F.xxhash64("key"), F.lit(share))).otherwise(F.col("key"))
    own, guest = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", "key"), F.col("guests")).cast("int")
    columns = ["key", "node", *_BITS, "n_shingles", "label", task.alias("task")]
    homes = deal.select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"), F.lit(True).alias("home"))
    asks = deal.where(rest).select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), guest.alias("guest"), F.lit(False).alias("home"))
    found = homes.unionByName(asks).groupBy("task", "own", "guest").applyInPandas(lambda rows: _block_links(rows, similarity), "a long, b long")
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(tables.written(found.distinct(), "found"))


# ----------------------------------------------------------------- exact classes


def _similar(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in left, index in right) of sets with that Jaccard similarity; without ``right`` each pair within ``left``, once.

    Shared members are counted by products of incidence matrices, whose
    columns are the members that both sides have.
    """
    same, right = right is None, left if right is None else right
    if not left or not right:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if same and len(left) == 2:  # most components
        shared = len(np.intersect1d(*left, assume_unique=True))
        ok = shared * (1 + similarity) >= similarity * (len(left[0]) + len(left[1])) - 1e-3
        return np.zeros(int(ok), dtype=np.int64), np.ones(int(ok), dtype=np.int64)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    known, column = np.unique(np.concatenate(left if same else left + right), return_inverse=True)
    n = int(sizes[0].sum())
    columns = column[:n], column[:n] if same else column[n:]
    counts = [np.bincount(c, minlength=len(known)) for c in columns]
    both = counts[0] > 1 if same else (counts[0] > 0) & (counts[1] > 0)
    number = np.where(both, np.cumsum(both) - 1, -1)
    entries = []
    for c, m in zip(columns, sizes):
        at, row = number[c], np.repeat(np.arange(len(m)), m)
        order = np.argsort(at, kind="stable")
        entries.append((at[order], row[order]))
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        parts = []
        for (at, row), m in zip(entries, sizes):
            part = slice(*np.searchsorted(at, (start, start + COLUMNS)))
            parts.append(np.zeros((len(m), min(COLUMNS, int(both.sum()) - start)), dtype=np.float32))
            parts[-1][row[part], at[part] - start] = 1
        shared += parts[0] @ parts[1].T
    found = [np.nonzero(shared[k : k + 256] * (1 + similarity) >= similarity * (sizes[0][k : k + 256, None] + sizes[1]) - 1e-3) for k in range(0, len(left), 256)]
    x, y = np.concatenate([f[0] + 256 * k for k, f in enumerate(found)]), np.concatenate([f[1] for f in found])
    ok = x < y if same else np.ones(len(x), dtype=bool)
    return x[ok], y[ok]


def _texts_of(kept: DataFrame, some: DataFrame, n: int, text_col: str, words: int) -> DataFrame:
    """``some`` with the column hashes (the sorted distinct shingles) of the text in row ``__row`` of ``kept``.

    A filter of bits leaves about those rows before texts are hashed; the join
    takes the right ones.
    """
    size = min(FILTER_BITS, max(64, 1 << (16 * max(1, n)).bit_length()))
    place = lambda: F.xxhash64("__row").bitwiseAND(F.lit(size - 1))
    found = some.select(place().alias("place")).selectExpr("shiftright(place, 6) as word", "shiftleft(1L, cast(place & 63 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(size // 64, dtype=np.uint64)
    filled[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    filled = kept.sparkSession.sparkContext.broadcast(filled)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array(filled.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1))
            made = [x.astype("<u8").tobytes() for x in shingle_sets(batch.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["__row", "hashes"])

    hashed = kept.select("__row", place().alias("place"), F.col(text_col).alias("text")).mapInArrow(make, "__row long, hashes binary")
    return hashed.join(small(some, n, BROADCAST_ROWS), "__row")


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in rows]


def _small_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    rows = rows.sort_values("component", kind="stable")
    sets, label = _sets(rows["hashes"]), np.arange(len(rows))
    edges = np.flatnonzero(np.diff(rows["component"].to_numpy())) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)]):
        x, y = _similar(sets[a:b], None, similarity)
        _unite(label, x + a, y + a)
    return _linked(label, rows["node"].to_numpy())


def _chunk_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Each member of a chunk with the least member of its class there and its number of links."""
    x, y = _similar(_sets(rows["hashes"]), None, similarity)
    label, nodes = np.arange(len(rows)), rows["node"].to_numpy()
    _unite(label, x, y)
    linked = _linked(label, nodes).set_index("a")["b"]
    return pd.DataFrame({"component": rows["component"], "chunk": rows["chunk"], "a": nodes, "b": linked.reindex(nodes).fillna(pd.Series(nodes, nodes)).to_numpy(dtype=np.int64), "degree": np.bincount(np.concatenate((x, y)), minlength=len(rows))})


def _cross_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the members and the guests of a chunk."""
    home = rows["home"].to_numpy()
    own, asks = rows[home], rows[~home]
    x, y = _similar(_sets(own["hashes"]), _sets(asks["hashes"]), similarity)
    label = np.arange(len(own) + len(asks))
    _unite(label, x, y + len(own))
    return _linked(label, np.concatenate((own["node"].to_numpy(), asks["node"].to_numpy())))


def exact_links(sets: DataFrame, sizes: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """Links between the nodes of a component whose sets of shingles have the similarity, as stars.

    ``sets`` has node, component and hashes; ``sizes`` has component and n_shingles.
    """
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    per = sizes.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    large = per.where((F.col("n") > CHUNK) | ((F.col("weight") > WEIGHT) & (F.col("n") > 2)))
    large = tables.written(large.select("component", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("weight") / WEIGHT)).cast("int").alias("chunks")), "large")
    n_large = large.count()
    large = small(large, n_large, BROADCAST_ROWS)
    few = sets.join(large, "component", "left_anti") if n_large else sets
    links = few.withColumn("task", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("task").applyInPandas(lambda rows: _small_links(rows.drop(columns="task"), similarity), "a long, b long")
    links = tables.written(links, "links")
    if not n_large:
        return links
    home = sets.join(large, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    home = tables.written(home.select("node", "component", "hashes", "chunks", "chunk"), "home")
    kinds = ["node", "component", "hashes", "chunk"]
    inner = tables.written(home.select(*kinds).groupBy("component", "chunk").applyInPandas(lambda rows: _chunk_links(rows, similarity), "component long, chunk int, a long, b long, degree long"), "inner")
    links = links.union(inner.where("a <> b").select("a", "b"))
    best = inner.where("degree > 0").groupBy("component", "chunk").agg(F.max(F.struct("degree", "a")).alias("best"))
    best = best.groupBy("component").agg(F.slice(F.sort_array(F.collect_list("best"), asc=False), 1, HUBS).alias("best"))  # a row for each chunk
    hubs = best.select("component", F.explode("best.a").alias("node"))
    asks = home.join(hubs, ["component", "node"]).select("node", "component", "hashes", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = home.select(*kinds).withColumn("home", F.lit(True)).unionByName(asks.withColumn("home", F.lit(False)))
    links = links.union(tables.written(met.groupBy("component", "chunk").applyInPandas(lambda rows: _cross_links(rows, similarity), "a long, b long"), "hubs"))
    # what is outside the largest class of its component meets all of the component
    labels = components(links).withColumnRenamed("component", "label")
    named = home.select("node", "component").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = tables.written(named, "named")
    main = named.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    rest = tables.written(named.join(main, "component").where("label <> main").select("node", "component"), "rest")
    counts = rest.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("guests"))
    if rest.isEmpty():
        return links
    homes = home.join(counts, "component").select("node", "component", "hashes", "chunk", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"), F.lit(True).alias("home"))
    asks = home.join(rest, ["component", "node"]).join(counts, "component").withColumn("guest", F.pmod(F.xxhash64("node", "component"), F.col("guests")).cast("int"))
    asks = asks.select("node", "component", "hashes", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "guest", F.lit(False).alias("home"))
    last = homes.unionByName(asks).groupBy("component", "chunk", "guest").applyInPandas(lambda rows: _cross_links(rows, similarity), "a long, b long")
    return links.union(tables.written(last, "last"))


# ------------------------------------------------------------------- the filter


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each group of near duplicates: that with the least id.

    Texts are linked if the Jaccard similarity of their distinct
    ``words``-word shingles is ``similarity`` at least (fewer words are one
    shingle).  A null id comes last, of repeated rows one stays, and texts
    without words, nulls among them, are copies of each other.  All columns
    stay, whatever their names.
    """
    spark = docs.sparkSession
    docs, back = set_aside(docs, "__row")
    id_col, text_col = ({v: k for k, v in back.items()}.get(c, c) for c in (id_col, text_col))
    lasting, tables = Tables(spark), Tables(spark)
    kept = lasting.written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    rows = kept.select("__row", F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    prints = tables.written(sketches(rows, words), "prints")
    order = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    first = [F.first(c).alias(c) for c in (*_BITS, "n_shingles", "keys")]
    nodes = tables.written(prints.groupBy("node").agg(*first, F.min(order).alias("least"), F.min("__row").alias("__row"), F.count("*").alias("n")), "nodes")
    near = components(candidate_links(nodes, similarity, tables))
    some = tables.written(near.join(nodes.select("node", "n_shingles", "__row"), "node"), "candidates")
    sets = tables.written(_texts_of(kept, some.select("__row", "node", "component"), some.count(), text_col, words), "sets")
    found = tables.written(components(exact_links(sets, some.select("component", "n_shingles"), similarity, tables)), "components")
    # rows that go: those of a node that is not alone, but for the least of its component
    groups = nodes.select("node", "least", "n").join(found, "node", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    stay = groups.groupBy("component").agg(F.min("least")["row"].alias("stays"))
    going = groups.join(stay, "component").select("node", "stays")
    gone = lasting.written(prints.select("__row", "node").join(going, "node").where("__row <> stays").select("__row"), "gone")
    left = kept.join(small(gone, gone.count(), BROADCAST_ROWS), "__row", "left_anti").drop("__row")
    tables.remove()
    return left.withColumnsRenamed(back)
