"""Small tables that are rules written out: logistic transfer, bit-history states, learning rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.registry import query


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def stretch(p: Column) -> Column:
    """256 ln(p / (4096 - p)) of a 12-bit probability, rounded and clamped."""
    p = clamp(p.cast("double"), 1, 4095)
    return clamp(F.round(256 * F.log(p / (4096 - p))), -2047, 2047).cast("int")


STRETCH_SQL = "CAST(greatest(-2047, least(2047, round(256 * ln(greatest(1.0, least(4095.0, {p})) / (4096 - greatest(1.0, least(4095.0, {p}))))))) AS INT)"


@query(f"SELECT CAST(i AS INT) AS i, CAST(greatest(1, least(4095, round(4096 / (1 + exp(-(i - 2048) / 256.0))))) AS INT) AS squash, {STRETCH_SQL.format(p='i')} AS stretch FROM range(4096) t(i)")
def logistic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic function over 12 bits and its inverse."""
    i = F.col("id")
    squash = clamp(F.round(4096 / (1 + F.exp(-(i - 2048) / 256.0))), 1, 4095).cast("int")
    return spark.range(4096).select(i.cast("int").alias("i"), squash.alias("squash"), stretch(i).alias("stretch"))


@query(f"""WITH s AS (SELECT s, s >> 4 AS n0, s & 15 AS n1 FROM range(256) t(s)), p AS (SELECT *, greatest(1, least(4095, round(4096 * (2 * n1 + 1) / (2 * n0 + 2 * n1 + 2)::DOUBLE))) AS p FROM s)
SELECT CAST(s AS INT) AS state, CAST(n0 AS INT) AS n0, CAST(n1 AS INT) AS n1, CAST(p AS INT) AS p12, {STRETCH_SQL.format(p='p')} AS stretched FROM p""")
def kt_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Krichevsky-Trofimov estimate of each pair of counts in a state byte."""
    s = spark.range(256).select(F.col("id").cast("int").alias("state"))
    s = s.withColumn("n0", F.shiftright("state", 4)).withColumn("n1", F.col("state").bitwiseAND(F.lit(15)))
    s = s.withColumn("p12", clamp(F.round(4096.0 * (2 * F.col("n1") + 1) / (2 * F.col("n0") + 2 * F.col("n1") + 2)), 1, 4095).cast("int"))
    return s.withColumn("stretched", stretch(F.col("p12")))


def next_counts(n0: Column, n1: Column, cap: int, keep: int) -> tuple[Column, Column]:
    """Counts after a 1: its own count grows to cap, a large opposite one is discounted."""
    return F.when(n0 > keep, F.shiftright(n0, 1) + 1).otherwise(n0), F.least(n1 + 1, F.lit(cap))


@query("""WITH t AS (SELECT s, b, s >> 4 AS c0, s & 15 AS c1, s >> 5 AS r0, (s >> 2) & 7 AS r1, s & 3 AS h FROM range(256) a(s), range(2) c(b))
SELECT CAST(s AS INT) AS state, CAST(b AS INT) AS bit,
CAST(CASE WHEN b = 1 THEN ((CASE WHEN c0 > 3 THEN (c0 >> 1) + 1 ELSE c0 END) << 4) | least(c1 + 1, 15) ELSE (least(c0 + 1, 15) << 4) | (CASE WHEN c1 > 3 THEN (c1 >> 1) + 1 ELSE c1 END) END AS INT) AS next_counts,
CAST((CASE WHEN b = 1 THEN ((CASE WHEN r0 > 2 THEN (r0 >> 1) + 1 ELSE r0 END) << 5) | (least(r1 + 1, 7) << 2) ELSE (least(r0 + 1, 7) << 5) | ((CASE WHEN r1 > 2 THEN (r1 >> 1) + 1 ELSE r1 END) << 2) END) | (((h << 1) | b) & 3) AS INT) AS next_recency FROM t""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each state byte goes after a 0 and a 1, in both packings."""
    t = spark.range(512).select(F.floor(F.col("id") / 2).cast("int").alias("state"), (F.col("id") % 2).cast("int").alias("bit"))
    s, one = F.col("state"), F.col("bit") == 1
    c0, c1, r0, r1, h = F.shiftright(s, 4), s.bitwiseAND(F.lit(15)), F.shiftright(s, 5), F.shiftright(s, 2).bitwiseAND(F.lit(7)), s.bitwiseAND(F.lit(3))
    (a0, a1), (b1, b0) = next_counts(c0, c1, 15, 3), next_counts(c1, c0, 15, 3)
    counts = F.when(one, F.shiftleft(a0, 4).bitwiseOR(a1)).otherwise(F.shiftleft(b0, 4).bitwiseOR(b1))
    (a0, a1), (b1, b0) = next_counts(r0, r1, 7, 2), next_counts(r1, r0, 7, 2)
    recent = F.when(one, F.shiftleft(a0, 5).bitwiseOR(F.shiftleft(a1, 2))).otherwise(F.shiftleft(b0, 5).bitwiseOR(F.shiftleft(b1, 2)))
    return t.select("state", "bit", counts.alias("next_counts"), recent.bitwiseOR(F.shiftleft(h, 1).bitwiseOR(F.col("bit")).bitwiseAND(F.lit(3))).alias("next_recency"))


@query("SELECT CAST(n AS INT) AS n, 65536 // (n + 2) AS rate, round(1.0 / (n + 1.5), 9) AS share, round(tanh(n / 64.0 - 2), 9) AS tanh, round(1 / (1 + exp(-(n / 64.0 - 2))), 9) AS sigmoid FROM range(256) t(n)")
def rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count-adaptive learning rates in 16 bits, and the scalar activations over a grid."""
    n = F.col("id")
    x = n / 64.0 - 2
    return spark.range(256).select(n.cast("int").alias("n"), F.floor(F.lit(65536) / (n + 2)).alias("rate"), F.round(1.0 / (n + 1.5), 9).alias("share"), F.round(F.tanh(x), 9).alias("tanh"), F.round(1 / (1 + F.exp(-x)), 9).alias("sigmoid"))
