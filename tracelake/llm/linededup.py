"""Drop lines that a large share of a site's pages has.

For each host the share of a line is the pages that have it over all pages of
the host.  Lines are counted by a digest, once for each page, so the counting
shuffle carries partial counts and no text; the lines found are at most
(distinct lines of a page) * ONE_IN for a host, and join the pages by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, written

#: A line goes if its share of the pages of its host is above one in so many, as far as so many pages tell.
ONE_IN = 20


def _lines(text):
    return F.split(text, "\n")


def common_enough(n: Column, pages: Column, one_in: int = ONE_IN) -> Column:
    """Whether ``n`` of ``pages`` say that the share is above 1 / one_in.

    n must exceed pages / one_in by (1 - 1 / one_in) * sqrt(pages): the lower
    bound of a share that is measured on few pages, at such a confidence that one
    page alone never says it.  There is no least number of pages; all pages of a
    host of two do.  In whole numbers, so that no rounding decides.
    """
    above = one_in * n - pages
    return (above > 0) & (above * above > (one_in - 1) ** 2 * pages)


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", one_in: int = ONE_IN) -> DataFrame:
    """host and the digests of its lines above the share.  A null host is a host of its own (here: a null byte)."""
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where("trim(line) <> ''")
    counts = lines.groupBy("host", F.unhex(F.md5("line")).alias("line")).agg(F.count("*").alias("n")).where("n > 1")  # one page never is enough
    above = counts.join(totals, "host").where(common_enough(F.col("n"), F.col("pages"), one_in))
    return above.groupBy("host").agg(F.collect_set("line").alias("common"))


def drop_boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", told: bool = True, **limits) -> DataFrame:
    """``docs`` with the text's boilerplate lines dropped, and if ``told`` n_lines and n_dropped.

    Blank lines stay.  A null text stays null with no lines, repeated rows are
    pages of their own (so all lines of a host that has nothing but copies of one
    page are on all of its pages, and go), an empty table gives no rows.  The
    other columns stay; the two new ones replace columns of their names, and
    without ``told`` there is no new one.
    """
    docs, back = set_aside(docs, "__host", "__common", "__kept")
    ours = {v: k for k, v in back.items()}
    text_col, host_col = ours.get(text_col, text_col), ours.get(host_col, host_col)
    common = written(boilerplate(docs, text_col=text_col, host_col=host_col, **limits), "boilerplate")
    common = common.select(F.col("host").alias("__host"), F.col("common").alias("__common"))
    lines = _lines(F.col(text_col))
    joined = docs.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))).join(common, "__host", "left")
    kept = F.when(F.col("__common").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__common"), F.unhex(F.md5(x)))))
    joined = joined.withColumn("__kept", kept)
    if told:
        n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
        n_kept = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__kept"))
        joined = joined.withColumns({"n_lines": n_lines, "n_dropped": n_lines - n_kept})
    return joined.withColumn(text_col, F.array_join("__kept", "\n")).drop("__host", "__common", "__kept").withColumnsRenamed(back)
