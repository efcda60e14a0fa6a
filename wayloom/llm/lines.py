"""Line dedup by site-relative frequency.

A line's key is the MD5 of the line without white space at its ends. For every site the pages that
contain a key are divided by the site's pages; lines over ``ratio`` on at least ``min_pages`` pages
are boilerplate and go from all pages of that site. Blank lines are never boilerplate.

Results in special cases: a null text stays null with 0 lines; an empty text has one blank line;
a null host is a site of its own; a line that repeats within a page counts once for it but is
dropped at each place; rows that repeat count as pages of their own, or with ``copies_once`` all rows of a
site with the same text as one page (null texts, too), so that copies don't make their own lines boilerplate; a
page may end up empty; an empty table gives an empty table. Columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.skew import salted_join
from wayloom.session import materialize

RATIO = 0.1
MIN_PAGES = 10
#: Up to so many boilerplate lines (16 bytes each) the table is broadcast; beyond, a salted join is used.
BROADCAST_LINES = 200_000
BLANK = " \t\r\x0b\x0c"


def _site(host: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))


def _keys(text: str):
    trimmed = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x, F.lit(BLANK)))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.unhex(F.md5(x)))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """Rows ``site, key, pages, site_pages`` of all boilerplate lines.

    One shuffle of (site, key) pairs, counted on the map side first, so neither a hot site nor a hot
    line gathers in a task. A site has less than (mean lines of a page) / ratio such lines. With
    ``copies_once`` a shuffle of (site, key, hash of the text) goes before, on which rows that repeat are merged.
    """
    pages = docs.select(_site(host).alias("site"), F.col(text).alias("text"))
    of_page = ["site"]
    if copies_once:
        pages, of_page = pages.withColumn("page", F.unhex(F.md5("text"))), ["site", "page"]
    total = pages.select(of_page)
    held = pages.select(*of_page, F.explode(F.array_distinct(_keys("text"))).alias("key"))
    if copies_once:
        total, held = total.distinct(), held.distinct()
    total = total.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    counts = (
        held.groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    return counts.join(total, "site").filter(F.col("pages") > ratio * F.col("site_pages"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``."""
    found = materialize(boilerplate(docs, host, text, ratio, min_pages, copies_once).select("site", "key"), "boilerplate")
    sites = found.groupBy(F.col("site").alias("__site")).agg(F.collect_set("key").alias("__bad"))
    rows = docs.withColumn("__site", _site(host))
    if found.count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(sites), "__site", "left")
    else:
        joined = salted_join(rows, sites, ["__site"], [text], "left")
    lines = F.split(F.col(text), "\n", -1)

    def kept(x):
        return ~F.array_contains(F.col("__bad"), F.unhex(F.md5(F.trim(x, F.lit(BLANK)))))

    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    rest = F.when(F.col("__bad").isNull(), lines).otherwise(F.filter(lines, kept))
    return (
        joined.withColumn("__n", n)
        .withColumn("__rest", rest)
        .withColumn("n_lines", F.col("__n"))
        .withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("__n") - F.size("__rest")).cast("long"))
        .withColumn(text, F.array_join("__rest", "\n"))
        .drop("__site", "__bad", "__n", "__rest")
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, chr(32)||chr(9)||chr(13)||chr(11)||chr(12)) AS key FROM l),
total AS (SELECT coalesce('=' || source, '-') AS site, count(*) AS n FROM documents GROUP BY 1),
bad AS (
  SELECT k.site, key FROM k JOIN total USING (site) WHERE key <> ''
  GROUP BY k.site, key, n HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > {RATIO}e0 * n),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.key IS NULL), '') AS kept
  FROM k LEFT JOIN bad ON bad.site = k.site AND bad.key = k.key GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)
"""


def query(docs: DataFrame) -> DataFrame:
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
