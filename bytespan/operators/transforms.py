"""Reversible byte transforms, their inverses, and the search for the one that lowers a block's entropy.

Transforms work on array<int> columns, so they stay inside a projection. A
byte-wise bijection or a permutation of places leaves a histogram as it is, so
of the eight candidates only the difference can gain; the search measures that
one and knows the others' gain to be 0.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytespan.functions.bytes import blocks, byte_array
from bytespan.functions.groups import Group, dealt, over_groups
from bytespan.operators.profile import BLOCKS_SQL, CLASSIFIED_SQL, block_entropies, classified, entropy_sql
from bytespan.registry import query
from bytespan.sources.blobs import MIXED_BLOBS_SQL, derived_blobs, mixed_blobs

#: Candidates by block tag, and the bits that naming one costs (fixed values).
CANDIDATES = ((1, "delta", 0), (2, "xor", 255), (3, "add", 128), (4, "rotate", 1), (5, "rotate", 4), (6, "shift", 1), (7, "interleave", 2), (8, "interleave", 4))
COST_BITS = 8.0


def shift(a: Column, k: int) -> Column:
    return F.transform(a, lambda x: F.pmod(x + k, F.lit(256)))


def xor(a: Column, mask: int) -> Column:
    return F.transform(a, lambda x: x.bitwiseXOR(F.lit(mask)))


def difference(a: Column, step: int = 0) -> Column:
    """Each byte less the one before (the first as it is), plus step."""
    return F.transform(a, lambda x, i: F.pmod(x - F.when(i > 0, F.get(a, i - 1)).otherwise(0) + step, F.lit(256)))


def undo_difference(rows: DataFrame, keys: list[str], column: str, step: int = 0) -> DataFrame:
    """(keys, column) with the running sums of an array column: positions are exploded, since a fold would copy what
    it has built at every byte."""
    each = rows.select(*keys, F.posexplode(column).alias("_p", "_x"))
    total = F.sum(F.col("_x") - step).over(Window.partitionBy(*keys).orderBy("_p"))
    each = each.withColumn("_x", F.pmod(total, F.lit(256)).cast("int"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_a")).select(*keys, F.transform("_a", lambda x: x["_x"]).alias(column))


def mirror(a: Column) -> Column:
    return F.reverse(a)


def rotate(a: Column, k: int) -> Column:
    k %= 8
    return F.transform(a, lambda x: (F.shiftleft(x, k).bitwiseOR(F.shiftright(x, 8 - k))).bitwiseAND(F.lit(255)))


def mask(a: Column, m: int) -> Column:
    """Forward only."""
    return F.transform(a, lambda x: x.bitwiseAND(F.lit(m)))


def interleave(a: Column, stride: int) -> Column:
    """Lanes one after another; null where the length is no multiple of stride, as lanes would then overlap."""
    n = F.size(a)
    lane = F.floor(n / stride).cast("int")
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, (F.pmod(i, lane) * stride + F.floor(i / lane)).cast("int")))
    return F.when((n > 0) & (F.pmod(n, F.lit(stride)) == 0), moved)


def undo_interleave(a: Column, stride: int) -> Column:
    n = F.size(a)
    lane = F.floor(n / stride).cast("int")
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, (F.pmod(i, F.lit(stride)) * lane + F.floor(i / stride)).cast("int")))
    return F.when((n > 0) & (F.pmod(n, F.lit(stride)) == 0), moved)


def repeat(a: Column, factor: int) -> Column:
    """Forward only."""
    return F.flatten(F.array_repeat(a, max(factor, 1)))


def scale(a: Column, numerator: int, denominator: int) -> Column:
    """Forward only: clamped at 255; a denominator of 0 changes nothing."""
    return F.transform(a, lambda x: F.least(F.floor(x * numerator / denominator), F.lit(255)).cast("int")) if denominator else a


def apply(a: Column, name: str, k: int) -> Column:
    return {"delta": difference, "xor": xor, "add": shift, "shift": shift, "rotate": rotate, "interleave": interleave}[name](a, k)


def as_bytes(a: Column) -> Column:
    return F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


CANDIDATES_SQL = "(VALUES " + ", ".join(f"({t}, '{n}', {k})" for t, n, k in CANDIDATES) + ") t(tag, op, k)"


@query(f"SELECT tag, op, k AS parameter, op || '(' || k || ')' AS label FROM {CANDIDATES_SQL}")
def transform_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates by block tag."""
    return catalog(spark).withColumn("label", F.concat("op", F.lit("("), "parameter", F.lit(")")))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*CANDIDATES], "tag int, op string, parameter int")


def delta_gain(found: DataFrame) -> DataFrame:
    """(doc_id, block, n, gain): the bits that differences save on each block (doc_id, block, chunk)."""
    return block_entropies(found).select("doc_id", "block", "n", "gain")


OPS_SQL = """
moved AS (SELECT doc_id, block, tag, len(b) AS n, CASE op
  WHEN 'delta' THEN list_transform(b, lambda x, i: (x - CASE WHEN i > 1 THEN b[i - 1] ELSE 0 END + 256) % 256)
  WHEN 'xor' THEN list_transform(b, lambda x: xor(x, k))
  WHEN 'rotate' THEN list_transform(b, lambda x: ((x << k) | (x >> (8 - k))) & 255)
  WHEN 'interleave' THEN CASE WHEN len(b) % k = 0 THEN list_transform(range(0, len(b)), lambda i: b[(i % (len(b) // k)) * k + i // (len(b) // k) + 1]) END
  ELSE list_transform(b, lambda x: (x + k) % 256) END AS m
  FROM arrays, """ + CANDIDATES_SQL + """),
mv AS (SELECT doc_id, block, tag, unnest(m) AS v FROM moved),"""
GAINS_SQL = f"""{OPS_SQL} {entropy_sql('me', 'mv', 'doc_id, block, tag')}, bv AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('be', 'bv')},
gains AS (SELECT me.doc_id, me.block, me.tag, be.n * (be.e - me.e) AS gain FROM me JOIN be ON me.doc_id = be.doc_id AND me.block = be.block)"""


@query(f"WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {GAINS_SQL} SELECT doc_id, block, tag, round(gain, 3) + 0.0 AS gain FROM gains")
def transform_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits that each candidate saves on each block; interleaving is left out where it would lose bytes."""
    gains = delta_gain(blocks(mixed_blobs(spark, sf_dir)))
    fits = (F.col("op") != "interleave") | (F.pmod("n", "parameter") == 0)
    rows = gains.crossJoin(F.broadcast(catalog(spark))).filter(fits)
    return rows.select("doc_id", "block", "tag", F.when(F.col("tag") == 1, F.round("gain", 3) + F.lit(0.0)).otherwise(0.0).alias("gain"))


@query(f"""WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {GAINS_SQL},
best AS (SELECT doc_id, block, tag, gain, row_number() OVER (PARTITION BY doc_id, block ORDER BY gain DESC, tag) AS r FROM gains WHERE gain > {COST_BITS})
SELECT doc_id, block, tag, round(gain, 3) AS gain FROM best WHERE r = 1""")
def best_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that saves most on each block, where it saves more than naming it costs."""
    gains = delta_gain(blocks(mixed_blobs(spark, sf_dir)))
    return gains.filter(F.col("gain") > COST_BITS).select("doc_id", "block", F.lit(1).alias("tag"), F.round("gain", 3).alias("gain"))


@query(f"""WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {OPS_SQL.rstrip(',')}, ops AS (SELECT doc_id, block, tag, n, m FROM moved WHERE doc_id < 0)
SELECT doc_id, block, tag, CAST(n AS INT) AS n, sha256(unhex(list_aggregate(list_transform(m, lambda x: printf('%02X', x)), 'string_agg', ''))) AS digest, true AS same FROM ops WHERE m IS NOT NULL""".replace("{OPS_SQL.rstrip(',')}", OPS_SQL.rstrip(",")))
def transform_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate applied to the blobs made by rule, and undone: a digest of the result, and whether the bytes return."""
    rows = blocks(derived_blobs(spark)).repartition("doc_id").select("doc_id", "block", byte_array("chunk").alias("b"))
    ops = F.array(*[F.struct(F.lit(t).alias("tag"), apply(F.col("b"), name, k).alias("m")) for t, name, k in CANDIDATES])
    # dealt out anew, so that what was applied is an array in hand, not an expression to be formed again
    done = rows.select("doc_id", "block", "b", F.explode(ops).alias("op")).select("doc_id", "block", "op.tag", "b", "op.m").repartition("doc_id", "tag")
    done = done.filter(F.col("m").isNotNull())
    back = F.lit(None).cast("array<int>")
    undo = {"xor": xor, "add": lambda a, k: shift(a, -k), "shift": lambda a, k: shift(a, -k), "rotate": lambda a, k: rotate(a, 8 - k), "interleave": undo_interleave}
    for tag, name, k in CANDIDATES:
        if name != "delta":
            back = F.when(F.col("tag") == tag, undo[name](F.col("m"), k)).otherwise(back)
    sums = undo_difference(done.filter("tag = 1"), ["doc_id", "block"], "m").withColumnRenamed("m", "sums").withColumn("tag", F.lit(1))
    done = done.join(sums, ["doc_id", "block", "tag"], "left")
    same = F.coalesce("sums", back) == F.col("b")
    return done.select("doc_id", "block", "tag", F.size("b").alias("n"), F.sha2(as_bytes(F.col("m")), 256).alias("digest"), same.alias("same"))


@query(f"""WITH {CLASSIFIED_SQL}, {GAINS_SQL}
SELECT c.doc_id, c.block, CASE WHEN passthrough THEN 255 WHEN use_transform AND g.gain > {COST_BITS} THEN 1 ELSE 0 END AS tag, c.n FROM classes c LEFT JOIN gains g ON c.doc_id = g.doc_id AND c.block = g.block AND g.tag = 1""")
def codec_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag that each block gets at a level that searches transforms: 255 stored, 1 to 8 transformed, 0 as it is."""
    return block_tags(mixed_blobs(spark, sf_dir))


def block_tags(blobs: DataFrame) -> DataFrame:
    """(doc_id, block, tag, n): one pass over the blocks gives their classes and what differences save on them."""
    c = classified(blobs)
    tag = F.when(F.col("passthrough"), 255).when(F.col("use_transform") & (F.col("gain") > COST_BITS), 1).otherwise(0)
    return c.select("doc_id", "block", tag.alias("tag"), "n")


#: mask() by 15 and scale() by 5 / 3 of every byte value.
MASKED, SCALED = bytes(x & 15 for x in range(256)), bytes(min(x * 5 // 3, 255) for x in range(256))


@query(f"""WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, d AS (SELECT doc_id, block, list_reverse(b) AS mirror, list_transform(b, lambda x: x & 15) AS mask, flatten(list_transform(range(3), lambda i: b)) AS repeat,
list_transform(b, lambda x: least(x * 5 // 3, 255)) AS scale FROM arrays)
SELECT doc_id, block, {", ".join(f"sha256(unhex(list_aggregate(list_transform({c}, lambda x: printf('%02X', x)), 'string_agg', ''))) AS {c}" for c in ("mirror", "mask", "repeat", "scale"))} FROM d""")
def transform_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every block mirrored, masked, repeated and scaled: the transforms that no search tries."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        cells = [g.data[a:b].tobytes() for a, b in zip(g.offset[:-1], g.offset[1:], strict=True)]
        made = {"mirror": lambda c: c[::-1], "mask": lambda c: c.translate(MASKED), "repeat": lambda c: c * 3, "scale": lambda c: c.translate(SCALED)}
        return {"doc_id": rows.column("doc_id"), "block": rows.column("block")} | {name: [hashlib.sha256(f(c)).hexdigest() for c in cells] for name, f in made.items()}

    rows = dealt(blocks(mixed_blobs(spark, sf_dir)).select("doc_id", "block", "chunk"), "doc_id", "block")
    return over_groups(rows, run, "doc_id long, block long, mirror string, mask string, repeat string, scale string", "chunk")
