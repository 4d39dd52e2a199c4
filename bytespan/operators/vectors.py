"""Numeric arrays: quantisation and dot products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.registry import query
from bytespan.sources.blobs import table

WIDE_SQL = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(f"""WITH {WIDE_SQL}, s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS scale FROM v)
SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(e, lambda x: CAST(CASE WHEN scale = 0 THEN 0 ELSE round(x / scale) END AS INT)), ',') AS codes FROM s""")
def quantize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as whole numbers of -127 to 127 and a scale."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    # named unlike the result: in a lambda a column of that name would be the rounded one
    v = v.withColumn("exact", F.array_max(F.transform("e", lambda x: F.abs(x))) / 127)
    codes = F.transform("e", lambda x: F.when(F.col("exact") == 0, 0).otherwise(F.round(x / F.col("exact"))).cast("int").cast("string"))
    return v.select("vec_id", F.round("exact", 9).alias("scale"), F.array_join(codes, ",").alias("codes"))


@query(f"""WITH {WIDE_SQL}, q AS (SELECT e AS q FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
SELECT vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * q[i])), 6) AS dot FROM v, q""")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's dot product with the vector of the smallest id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = v.agg(F.min_by("e", "vec_id").alias("q"))  # a single row
    dot = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot, 6).alias("dot"))


def softmax(values: Column) -> Column:
    """The softmax of an array; the largest is subtracted first, so that no exponential overflows."""
    most = F.array_max(values)
    return F.transform(values, lambda x: F.exp(x - most) / F.aggregate(values, F.lit(0.0), lambda a, y: a + F.exp(y - most)))


@query(f"""WITH {WIDE_SQL}, m AS (SELECT vec_id, e, list_max(e) AS m FROM v), x AS (SELECT vec_id, list_transform(e, lambda t: exp(t - m)) AS x FROM m), s AS (SELECT vec_id, x, list_sum(x) AS s FROM x)
SELECT vec_id, round(list_max(x) / s, 9) AS most, round(-list_sum(list_transform(x, lambda t: t / s * ln(t / s))), 6) AS entropy, true AS sums_to_one FROM s""")
def softmax_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as logits: the largest probability, the entropy, and whether the probabilities sum to 1."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", softmax(F.col("embedding").cast("array<double>")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x))
    return v.select("vec_id", F.round(F.array_max("p"), 9).alias("most"), F.round(-total(lambda x: x * F.log(x)), 6).alias("entropy"), (F.abs(total(lambda x: x) - 1) < 1e-9).alias("sums_to_one"))
