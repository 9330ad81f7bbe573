"""Site-relative line deduplication of web pages, in DataFrame operations.

A page's lines are its text between block-level tags, white space collapsed.  For each
host, the pages that contain a line are counted, and a line that repeats (stands on two
pages at least) and stands on more than ``ratio`` of the host's pages is boilerplate
there and is dropped from all its pages.  Lines are counted by MD5; a host's boilerplate is at most
(lines a page / ratio) digests, so one row holds it.

Defined results: null or empty html has no lines; a host of one page loses no line (a
share of one page tells nothing); a page whose url is null or names no
host belongs to no site and keeps all lines; a line counts once a page however often it
stands there; repeated rows count as pages of their own; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which one host's lines are dealt.
SALT = 32

_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_TAG = r"<[^>]*>"
_BLANK = r"[ \t\r\f]+"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def page_lines(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, to in ((_HIDDEN, ""), (_BLOCK, "\n"), (_TAG, ""), (_BLANK, " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float) -> DataFrame:
    """(host, lines): the digests of each host's boilerplate lines."""
    sites = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    lines = sites.select("host", F.explode(F.array_distinct(page_lines(F.col("html")))).alias("line"))
    counted = lines.groupBy("host", F.unhex(F.md5("line")).alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    totals = sites.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
    found = salted.join(dealt, ["host", "salt"]).where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("digest").alias("found"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.25) -> DataFrame:
    """page_id, host, n_lines, n_dropped and kept_text (lines joined by line feeds)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    # A host's pages are dealt out, its few digests copied: no task gets a whole site.
    salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")
    copied = boilerplate(pages, ratio).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = own.withColumn("salt", salt).join(copied, ["host", "salt"], "left")
    cut = joined.select("page_id", "host", page_lines(F.col("html")).alias("lines"), "found")
    keeps = F.when(F.col("found").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("found"), F.unhex(F.md5(x)))))
    return cut.select("page_id", "host", "lines", keeps.alias("kept")).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return done.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{_HIDDEN}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g'), '{_BLANK}', ' ', 'g'),
      chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
sites AS (SELECT host, count(*) AS pages FROM cut WHERE host <> '' GROUP BY host),
seen AS (SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut WHERE host <> '') GROUP BY host, line),
bad AS (SELECT seen.host, line FROM seen JOIN sites USING (host) WHERE n > 1 AND n > 0.25 * pages),
flat AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM cut),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS txt, count(*) AS n FROM flat
  WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.host = flat.host AND bad.line = flat.line) GROUP BY r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)
"""
