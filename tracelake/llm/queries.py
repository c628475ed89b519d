"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, extract, linededup, merkle, packing, periodic, perplexity, retrieval, simhash, sstable, tokencount, urlfilter
from .common import small_batches

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The list of op6 stands for one that is given: canonical URLs with an MD5 digest that begins so, one in four of each host.
LISTED = "[0-3]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
        F.coalesce(F.get("matches", F.lit(0))["length"], F.lit(0)).cast("long").alias("longest"),
        F.get("matches", F.lit(0))["at"].cast("long").alias("longest_at"),
        F.get("matches", F.lit(0))["item"].alias("longest_item"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    host, path = urlfilter.host_and_path(F.col("url"))
    parts = pages.select(host.alias("host"), path.alias("path"))
    listed = parts.select(urlfilter.canonical(F.col("host"), F.col("path")).alias("url")).where(F.md5("url").rlike(f"^{LISTED}"))
    return urlfilter.filter_urls(pages, listed, RULES)


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, end_id=2)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("least"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    found = found.select("*", (-F.col("best.first")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.least")).alias("period"))
    return found.withColumn("exponent_milli", F.expr("1000 * length div period")).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_products(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, 10)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_quality_classifier, op4_line_dedup, op5_token_counts, op6_url_filter, op7_token_table, op8_near_duplicates, op9_packing, op10_main_text, op11_periodic_runs, op12_merkle_manifest, op13_exact_top_k)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 of a decimal doc_id, from the table t of its 256 remainders.
_CRC_TABLE = "crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars"))) + " || {})"
_NODES = "SELECT grp, 0 AS level, pos, d, n FROM {leaves} UNION ALL SELECT grp, level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM {nodes} WHERE n > 1 GROUP BY grp, level, pos // 8"
#: Of each leaf and level the digests before and after its own one in their run.
_STEPS = """SELECT l.grp, l.pos, t.level, coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS a,
       coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS b
FROM {leaves} l JOIN {nodes} t ON l.grp = t.grp AND t.n > 1 AND t.pos // 8 = l.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY 1, 2, 3"""

ORACLE_SQL = {
    "op11_periodic_runs": rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents, crcs),
e AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(1, len(w)) AS a, 3 + (h // 10) % 8 AS parts FROM d),
x AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM e),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches l WHERE NOT EXISTS (SELECT 1 FROM stretches r WHERE r.doc_id = l.doc_id AND r.q < l.q AND r.s <= l.s AND r.s + r.m >= l.s + l.m)),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM runs GROUP BY 1),
best AS (SELECT doc_id, s AS start, m AS length, q AS period FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM x LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {_LEAF.format(_field('text'))} AS d,
         {_LEAF.format(_field(f"CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"))} AS copy FROM documents, crcs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, d) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM docs),
nodes AS ({_NODES.format(leaves='leaves', nodes='nodes')}),
subroots AS (SELECT '' AS grp, grp AS lang, d, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS ({_NODES.format(leaves='subroots', nodes='tops')}),
steps AS (SELECT grp, pos, list(a || '|' || b ORDER BY level) AS s, string_agg(a || b, '' ORDER BY level) AS proof FROM ({_STEPS.format(leaves='leaves', nodes='nodes')}) GROUP BY 1, 2),
above AS (SELECT pos, list(a || '|' || b ORDER BY level) AS s, string_agg(a || b, '' ORDER BY level) AS proof FROM ({_STEPS.format(leaves='subroots', nodes='tops')}) GROUP BY 1),
rooted AS (SELECT doc_id, l.d AS leaf, r.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, copy,
           list_concat(coalesce(steps.s, []), coalesce(above.s, [])) AS s, coalesce(steps.proof, '') || coalesce(above.proof, '') AS proof
           FROM leaves l JOIN subroots r ON l.grp = r.lang LEFT JOIN steps ON steps.grp = l.grp AND steps.pos = l.pos LEFT JOIN above ON above.pos = r.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_prepend(copy, s), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root FROM rooted)
""",
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM bp),
sizes AS (SELECT DISTINCT n FROM windows),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, p, n FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp) JOIN windows USING (n, k)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1),
starts AS (SELECT DISTINCT b.item_id, b.n, b.p AS q, array_to_string(b.w[b.p:b.p + b.n - 1], ' ') AS k FROM bp b),
pairs AS (SELECT h.doc_id, h.p, h.n, s.item_id, s.q FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp) h JOIN starts s USING (n, k)),
lines AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS line FROM pairs),
matches AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(p) - 1 AS longest_at, count(*) + any_value(n) - 1 AS longest FROM lines GROUP BY doc_id, item_id, p - q, line),
best AS (SELECT doc_id, longest, longest_at, item AS longest_item FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, longest_at, item) = 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0) AS longest, longest_at, longest_item
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
""",
    "op4_line_dedup": rf"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM p GROUP BY 1),
counts AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM p) WHERE trim(line) <> '' GROUP BY 1, 2),
common AS (SELECT source, list(line) AS common FROM counts JOIN totals USING (source) WHERE {linededup.ONE_IN} * n > pages AND ({linededup.ONE_IN} * n - pages) * ({linededup.ONE_IN} * n - pages) > {(linededup.ONE_IN - 1) ** 2} * pages GROUP BY 1),
kept AS (SELECT doc_id, source, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM p LEFT JOIN common USING (source))
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS INT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS INT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM kept
""",
    "op6_url_filter": rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)+$', '') AS url,
      CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
listed AS (SELECT DISTINCT url FROM c WHERE regexp_matches(md5(url), '^{LISTED}') AND url <> '')
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM c
""",
    "op13_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false)))),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""",
}
