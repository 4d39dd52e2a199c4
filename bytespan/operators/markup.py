"""Markup structure of pages: bracket nesting, element counts, element depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.registry import query
from bytespan.sources.blobs import table

#: Depth at which the bracket stack, and the element stack, stop growing (fixed values).
BRACKETS, ELEMENTS = 16, 8
BRACKETS_SQL = f"""WITH c AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '[\\[\\](){{}}]') AS b FROM pages),
d AS (SELECT page_id, len(b) AS n, list_transform(b, lambda x: CASE WHEN x IN ('[', '(', '{{') THEN 1 ELSE -1 END) AS s FROM c)
SELECT page_id, n, CASE WHEN n = 0 THEN 0 ELSE list_reduce(s, lambda a, x: least({BRACKETS}, greatest(0, a + x)), 0) END AS final_depth FROM d"""


@query(BRACKETS_SQL)
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets of each page and the depth at its end: any closer closes, never below 0 nor above 16."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"[\[\](){}]"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("b"))
    step = lambda a, x: F.least(F.lit(BRACKETS), F.greatest(F.lit(0), a + F.when(x.isin("[", "(", "{"), 1).otherwise(-1)))
    return rows.select("page_id", F.size("b").cast("long").alias("n"), F.aggregate("b", F.lit(0), step).alias("final_depth"))


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(html, '<(/?[A-Za-z0-9_:]+)', 1)) AS tag FROM pages)
SELECT lower(ltrim(tag, '/')) AS tag, count(*) FILTER (tag[1] <> '/') AS n_open, count(*) FILTER (tag[1] = '/') AS n_close FROM t GROUP BY 1""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing tags by element."""
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<(/?[A-Za-z0-9_:]+)"), F.lit(1))).alias("t"))
    closing = F.col("t").startswith("/")
    return tags.groupBy(F.lower(F.ltrim("t", F.lit("/"))).alias("tag")).agg(F.count(F.when(~closing, 1)).alias("n_open"), F.count(F.when(closing, 1)).alias("n_close"))


def nesting(page: Column | str) -> Column:
    """(tags, deepest, depth at the end) of a forgiving element stack: every other tag than a closing or self-closed one
    pushes, comments and void elements too, as a context needs no parser. Depth and deepest are folded as one number."""
    step = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
    depth = lambda a, t: F.least(F.lit(ELEMENTS), F.greatest(F.lit(0), F.shiftright(a, 8) + step(t)))
    tags = F.regexp_extract_all(page, F.lit("<[^>]*>"), F.lit(0))
    last = F.aggregate(tags, F.lit(0), lambda a, t: F.shiftleft(depth(a, t), 8) + F.greatest(a.bitwiseAND(F.lit(255)), depth(a, t)))
    return F.struct(F.size(tags).cast("long").alias("n_tags"), last.bitwiseAND(F.lit(255)).cast("long").alias("deepest"), F.shiftright(last, 8).cast("long").alias("final_depth"))


DEPTH_SQL = f"least({ELEMENTS}, greatest(0, (a >> 8) + x))"


@query(f"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '<[^>]*>'), lambda t: CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN 0 ELSE 1 END) AS s FROM pages),
d AS (SELECT page_id, len(s) AS n, CASE WHEN len(s) = 0 THEN 0 ELSE list_reduce(s, lambda a, x: ({DEPTH_SQL} << 8) + greatest(a & 255, {DEPTH_SQL}), 0) END AS last FROM t)
SELECT page_id, CAST(n AS BIGINT) AS n_tags, CAST(last & 255 AS BIGINT) AS deepest, CAST(last >> 8 AS BIGINT) AS final_depth FROM d""")
def tag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element nesting of each page."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return rows.select("page_id", nesting("html").alias("d")).select("page_id", "d.*")
