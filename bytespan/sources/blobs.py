"""Binary cells: documents and pages as bytes, and blobs made by rule that reach the branches text never does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): the UTF-8 bytes of every document; a null text is an empty blob."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def two_digits(value):
    return F.lpad(F.hex(value.cast("long")), 2, "0")


def derived_blobs(spark: SparkSession) -> DataFrame:
    """(doc_id, data) of blobs of 4096 bytes under negative ids: noise (-1..-6), ramp (-11), two interleaved ramps
    (-12), soft ramps of modulus 16, 20 and 28 (-13..-15), and noise behind the magic of PNG, gzip and MP4 (-16..-18)."""
    noise = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(127)), lambda j: F.sha2(F.concat_ws("-", F.lit(k), j.cast("string")), 256)), "")
    each = lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: two_digits(F.pmod(f(i), F.lit(256)))), "")
    byte = lambda i: F.conv(F.substring(F.col("n1"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    soft = lambda m: each(lambda i: F.pmod(F.floor(i / 16), F.lit(32)) + F.pmod(byte(i), F.lit(m)))
    recipes = [(-k - 1, noise(str(k))) for k in range(6)]
    recipes += [(-11, each(lambda i: i)), (-12, each(lambda i: F.floor(i / 2) * 3 + F.pmod(i, F.lit(2)) * 97))]
    recipes += [(-13, soft(16)), (-14, soft(20)), (-15, soft(28))]
    recipes += [(i, F.concat(F.lit(p), F.substring(noise("9"), 1, 8192 - len(p)))) for i, p in ((-16, "89504E47"), (-17, "1F8B08"), (-18, "00000018667479706D703432"))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), h.alias("h")) for i, h in recipes]))
    one = spark.range(1).select(noise("1").alias("n1"))
    return one.select(rows.alias("r")).select("r.doc_id", F.unhex("r.h").alias("data"))


def mixed_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_blobs(spark, sf_dir).unionByName(derived_blobs(spark))


#: SQL of document_blobs and mixed_blobs: blobs (doc_id, h), h in upper-case hex.
DOCUMENT_BLOBS_SQL = "blobs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
MIXED_BLOBS_SQL = """
noise AS (SELECT k, string_agg(sha256(k || '-' || j), '' ORDER BY j) AS h FROM range(0, 10) a(k), range(0, 128) b(j) GROUP BY k),
soft AS (SELECT m, string_agg(printf('%02X', ((i // 16) % 32 + ('0x' || substr(h, CAST(2 * i + 1 AS INT), 2))::INT % m) % 256), '' ORDER BY i) AS h
         FROM noise, range(0, 4096) a(i), (VALUES (16), (20), (28)) b(m) WHERE k = 1 GROUP BY m),
blobs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
  UNION ALL SELECT -k - 1, upper(h) FROM noise WHERE k < 6
  UNION ALL SELECT -11, string_agg(printf('%02X', i % 256), '' ORDER BY i) FROM range(0, 4096) a(i)
  UNION ALL SELECT -12, string_agg(printf('%02X', ((i // 2) * 3 + (i % 2) * 97) % 256), '' ORDER BY i) FROM range(0, 4096) a(i)
  UNION ALL SELECT CASE m WHEN 16 THEN -13 WHEN 20 THEN -14 ELSE -15 END, h FROM soft
  UNION ALL SELECT i, p || substr(upper(h), 1, 8192 - length(p)) FROM noise, (VALUES (-16, '89504E47'), (-17, '1F8B08'), (-18, '00000018667479706D703432')) m(i, p) WHERE k = 9
)"""
