"""Planning: levels, segments, model memory and parallelism, civil dates and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytespan.registry import query
from bytespan.sources.blobs import table

# log2 of the segment size by level; each context model's kind and the cap on log2 of its buckets.
SEGMENT_BITS = {1: 20, 2: 21, 3: 22, 4: 23, 5: 24, 6: 25, 7: 26, 8: 26, 9: 28}
KINDS = ["hash"] * 8 + ["sparse"] * 6 + ["stride"] * 4 + ["ind"] * 3 + ["hash"] * 5 + ["ind", "sparse", "sparse", "hash"]
CAPS = [21, 24, 31, 31, 31, 31, 31, 31, 14, 14, 21, 21, 21, 21, 21, 21, 21, 21, 21, 24, 24, 31, 31, 31, 31, 24, 24, 19, 24, 31]
TURBO_MODELS, BUCKET_BYTES, INPUTS, BUDGET = 5, 16, 72, 16 << 30
LEVELS_SQL = "levels AS (SELECT * FROM (VALUES " + ", ".join(f"({lv}, CAST({1 << b} AS BIGINT), {str(lv <= 3).lower()}, {max(lv - 6, 0)})" for lv, b in SEGMENT_BITS.items()) + ") t(level, segment_size, turbo, memory))"
MODELS_SQL = "models AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {c})" for i, (k, c) in enumerate(zip(KINDS, CAPS, strict=True))) + ") t(model, kind, cap))"


def levels(spark: SparkSession) -> DataFrame:
    """Nine rows: level, segment_size, turbo, memory (profile 0 to 3)."""
    return spark.createDataFrame([(lv, 1 << b, lv <= 3, max(lv - 6, 0)) for lv, b in SEGMENT_BITS.items()], "level int, segment_size long, turbo boolean, memory int")


@query(f"WITH {LEVELS_SQL} SELECT level, segment_size, turbo, memory, CASE WHEN level <= 3 THEN 'fast' WHEN level <= 6 THEN 'balanced' ELSE 'best' END AS label FROM levels")
def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level stands for."""
    return levels(spark).withColumn("label", F.when(F.col("level") <= 3, "fast").when(F.col("level") <= 6, "balanced").otherwise("best"))


def raw_bits(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int") + 3


def model_sizes(rows: DataFrame) -> DataFrame:
    """rows (level, n, turbo, memory) with model_bytes: what a model over n bytes allocates."""
    spark = rows.sparkSession
    models = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(zip(KINDS, CAPS, strict=True))], "model int, kind string, cap int")
    raw, mem = raw_bits(F.col("n")), F.when(F.col("turbo"), 0).otherwise(F.col("memory"))
    extra = F.greatest(mem - 1, F.lit(0))
    std = F.greatest(F.lit(11), F.least(F.lit(19), F.greatest(F.lit(14), F.least(F.lit(22), raw)) - 3))
    std = F.when(F.col("kind") == "hash", std).when(F.col("kind") == "ind", F.least(std, F.lit(18))).otherwise(F.least(std, F.lit(16)))
    bits = F.least(F.when(mem >= 1, F.greatest(F.lit(11), F.least(23 + extra, raw))).otherwise(std), F.col("cap"))
    used = rows.crossJoin(F.broadcast(models)).filter(~F.col("turbo") | (F.col("model") < TURBO_MODELS))
    tables = used.groupBy("level", "n", "turbo", "memory").agg(F.sum(BUCKET_BYTES * F.pow(F.lit(2.0), bits)).cast("long").alias("tables"))
    match = F.when(mem >= 1, F.greatest(F.lit(14), F.least(24 + extra, raw))).otherwise(F.greatest(F.lit(14), F.least(F.lit(22), raw)))
    profile = F.when(mem == 0, 13).when(mem == 1, 16).when(mem == 2, 18).otherwise(19)
    by_input = F.greatest(F.lit(13), F.ceil(F.log2(F.greatest(F.col("n") / 64, F.lit(1.0)))))
    rows_of = F.pow(F.lit(2.0), F.when(F.col("turbo"), 13).otherwise(F.least(profile, by_input))).cast("long")
    indirect = 65536 + 3 * F.pow(F.lit(2.0), F.when(mem >= 1, 22).otherwise(20)).cast("long")
    total = F.col("tables") + 8 * F.pow(F.lit(2.0), match).cast("long") + indirect + rows_of * (3 * INPUTS * 4 + 66) + F.col("n")
    return tables.select("level", "n", "turbo", "memory", total.alias("model_bytes"))


MEMORY_SQL = f"""{LEVELS_SQL}, {MODELS_SQL},
p AS (SELECT level, segment_size AS n, turbo, CASE WHEN turbo THEN 0 ELSE memory END AS mem, CAST(floor(log2(segment_size)) AS INT) + 3 AS raw FROM levels),
b AS (SELECT level, n, turbo, mem, raw, least(cap, CASE WHEN mem >= 1 THEN greatest(11, least(23 + greatest(mem - 1, 0), raw))
  ELSE least(CASE kind WHEN 'hash' THEN 99 WHEN 'ind' THEN 18 ELSE 16 END, greatest(11, least(19, greatest(14, least(22, raw)) - 3))) END) AS bits FROM p, models WHERE NOT turbo OR model < {TURBO_MODELS}),
t AS (SELECT level, n, turbo, mem, raw, sum({BUCKET_BYTES} * (1::BIGINT << bits)) AS tables FROM b GROUP BY ALL),
m AS (SELECT *, 1::BIGINT << CASE WHEN mem >= 1 THEN greatest(14, least(24 + greatest(mem - 1, 0), raw)) ELSE greatest(14, least(22, raw)) END AS match,
  1::BIGINT << CASE WHEN turbo THEN 13 ELSE least(CASE mem WHEN 0 THEN 13 WHEN 1 THEN 16 WHEN 2 THEN 18 ELSE 19 END, greatest(13, CAST(ceil(log2(n / 64)) AS INT))) END AS rows_ FROM t),
memory AS (SELECT level, n, turbo, mem, CAST(tables + 8 * match + 65536 + 3 * (1::BIGINT << CASE WHEN mem >= 1 THEN 22 ELSE 20 END) + rows_ * {3 * INPUTS * 4 + 66} + n AS BIGINT) AS model_bytes FROM m)"""


@query(f"WITH {MEMORY_SQL} SELECT level, n AS segment_size, model_bytes FROM memory")
def model_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of one model over a full segment at each level."""
    return model_sizes(levels(spark).withColumnRenamed("segment_size", "n")).select("level", F.col("n").alias("segment_size"), "model_bytes")


@query(f"WITH {MEMORY_SQL}, c AS (SELECT unnest([4, 8, 16, 64]) AS cores) SELECT level, cores, CAST(least(cores, greatest(1, {BUDGET} * 2 // 3 // model_bytes)) AS BIGINT) AS workers FROM memory, c")
def worker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of each level fit into two thirds of 16 GiB at once, by number of cores."""
    rows = model_memory(spark, sf_dir).withColumn("cores", F.explode(F.array(*map(F.lit, (4, 8, 16, 64)))))
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(BUDGET * 2 // 3) / F.col("model_bytes")))
    return rows.select("level", "cores", F.least(F.col("cores").cast("long"), fits).alias("workers"))


@query(f"""WITH {LEVELS_SQL}, a AS (SELECT source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size FROM documents GROUP BY source)
SELECT source AS archive, level, s AS segment, s * segment_size AS "offset", least(segment_size, size - s * segment_size) AS n FROM a, levels, unnest(range(0, (size + segment_size - 1) // segment_size)) u(s)""")
def segment_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each archive (one per source) at every level."""
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("archive")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    rows = sizes.filter("size > 0").crossJoin(F.broadcast(levels(spark)))
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("segment_size")))))
    start = F.col("segment") * F.col("segment_size")
    return rows.select("archive", "level", "segment", start.alias("offset"), F.least(F.col("segment_size"), F.col("size") - start).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def civil_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by civil minute and day number."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, len(l) AS n, round(list_reduce(l, lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.6 * a + 0.4 * x END, 0.0::DOUBLE), 6) AS ema FROM s""")
def throughput_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average 0.6 / 0.4 of each user's values in order of time, seeded by the first that isn't 0.

    The average is a weighted sum: a value counts 0.4 times 0.6 for each later one, the seed without the 0.4. So it is an
    aggregation over numbered rows, and no user's history stands in one row."""
    e = table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("user_id")
    rows = e.select("user_id", "value", F.row_number().over(order).alias("i"))
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("seed", F.min(F.when(F.col("value") != 0, F.col("i"))).over(whole))
    share = F.pow(F.lit(0.6), F.col("n") - F.col("i")) * F.when(F.col("i") == F.col("seed"), 1.0).otherwise(0.4)
    ema = F.sum(F.when(F.col("i") >= F.col("seed"), share * F.col("value")).otherwise(0.0))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(ema, 6).alias("ema"))
