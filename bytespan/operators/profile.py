"""Block profiling: layout, entropy, format sniffing, incompressibility, classification, text tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.functions.bytes import BLOCK, blocks, byte_array
from bytespan.functions.groups import Group, bytes_of, dealt, over_batches, over_groups
from bytespan.registry import query
from bytespan.sources.blobs import DOCUMENT_BLOBS_SQL, MIXED_BLOBS_SQL, document_blobs, mixed_blobs

#: Thresholds of the classifier, in bits per byte (fixed values).
HIGH, STRUCTURED, DELTA_GAIN, TRANSFORM_BELOW = 7.5, 7.0, 0.5, 6.0
#: Leading bytes of formats that are compressed already (fixed values), in hex; dots stand for any byte.
MAGIC = (
    ("jpeg", "FFD8FF"), ("png", "89504E47"), ("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("gzip", "1F8B"), ("zstd", "28B52FFD"),
    ("lz4", "04224D18"), ("7z", "377ABCAF"), ("rar", "52617221"), ("mp3", "FFFB"), ("mp3", "FFF3"), ("mp3", "FFF2"), ("mp3", "494433"),
    ("mp4", "........66747970"), ("ogg", "4F676753"), ("riff", "52494646"), ("flac", "664C6143"),
)

BLOCKS_SQL = """
blocks AS (SELECT doc_id, k AS block, substr(h, CAST(k * 8192 + 1 AS INT), 8192) AS c FROM blobs, unnest(range(0, (length(h) + 8191) // 8192)) u(k)),
arrays AS (SELECT doc_id, block, list_transform(regexp_extract_all(c, '..'), lambda x: ('0x' || x)::INT) AS b FROM blocks)"""


def entropy_sql(name: str, source: str, keys: str = "doc_id, block") -> str:
    """A common table expression with the entropy e of the values v of source by keys."""
    return f"{name} AS (SELECT {keys}, sum(c) AS n, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS e FROM (SELECT {keys}, v, count(*) AS c FROM {source} GROUP BY {keys}, v) GROUP BY {keys})"


@query(f"WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL} SELECT doc_id, block, block * {BLOCK} AS \"offset\", length(c) // 2 AS n FROM blocks")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4096-byte windows of every blob."""
    return blocks(mixed_blobs(spark, sf_dir)).select("doc_id", "block", (F.col("block") * BLOCK).alias("offset"), "n")


#: n log2 n of the counts that a block can have.
LOGS = np.r_[0.0, np.arange(1, BLOCK + 1) * np.log2(np.arange(1, BLOCK + 1))]


def n_log_n(n: np.ndarray) -> np.ndarray:
    return LOGS[n] if n.max(initial=0) < len(LOGS) else n * np.log2(np.maximum(n, 1))


def counted(values: np.ndarray, blob: np.ndarray, n: int) -> np.ndarray:
    """[blob, value] -> how often."""
    return np.bincount(blob.astype(np.int64) << 8 | values, minlength=n << 8).reshape(n, 256)


def entropy_of(total: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Bits per byte of histograms of so many bytes with this sum of n log2 n, 0 without bytes."""
    some = np.maximum(total, 1)
    return np.maximum(np.log2(some) - logs / some, 0)


def strided(g: Group, stride: int) -> np.ndarray:
    """[blob, value] -> how often a byte less the one stride places before it has this value modulo 256."""
    at = np.flatnonzero(g.place >= stride)
    return counted(g.data[at] - g.data[at - stride], g.blob[at], g.n)


def block_profile(g: Group) -> dict[str, np.ndarray]:
    """For every block its size n, entropy e0, entropy e1 of its differences, gain in bits as differences (its first byte as
    it is), and where e0 is above HIGH the least entropy of its differences at strides 1 to 4, else infinity."""
    row, n = np.arange(g.n), g.size
    e0 = entropy_of(n, n_log_n(counted(g.data, g.blob, g.n)).sum(1))
    gaps = strided(g, 1)
    logs = n_log_n(gaps).sum(1)
    # the first byte's value is one more of its kind among the differences
    same = gaps[row, g.data[g.offset[:-1]]]
    with_first = entropy_of(n, logs - n_log_n(same) + n_log_n(same + 1))
    e1, least = entropy_of(n - 1, logs), np.full(g.n, np.inf)
    if len(high := np.flatnonzero(e0 > HIGH)):
        least[high] = e1[high]
        few = Group(np.concatenate([g.data[g.offset[i] : g.offset[i + 1]] for i in high]), np.cumsum(np.r_[0, n[high]]))
        for stride in (2, 3, 4):
            least[high] = np.minimum(least[high], entropy_of(few.size - stride, n_log_n(strided(few, stride)).sum(1)))
    return {"n": n, "e0": e0, "e1": e1, "gain": n * (e0 - with_first), "least": least}


def block_entropies(found: DataFrame) -> DataFrame:
    """(doc_id, block, n, e0, e1, gain, least, and magic where found has it) of (doc_id, block, chunk): block_profile() of
    every block. Blocks are dealt out once, by (doc_id, block), and counted where they are."""
    carried = [c for c in ("magic",) if c in found.columns]

    def run(rows: pa.RecordBatch, g: Group) -> dict:
        return {c: rows.column(c) for c in ("doc_id", "block", *carried)} | block_profile(g)

    rows = dealt(found.select("doc_id", "block", "chunk", *carried), "doc_id", "block")
    return over_groups(rows, run, "doc_id long, block long, " + "".join(f"{c} boolean, " for c in carried) + "n long, e0 double, e1 double, gain double, least double", "chunk")


@query(f"WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, v AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('e', 'v')} SELECT doc_id, block, CAST(n AS BIGINT) AS n, round(e, 6) AS entropy FROM e")
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits per byte of every block."""
    return own_entropies(blocks(mixed_blobs(spark, sf_dir))).withColumn("entropy", F.round("entropy", 6))


def own_entropies(found: DataFrame) -> DataFrame:
    """(doc_id, block, n, entropy) of (doc_id, block, chunk)."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        return {"doc_id": rows.column("doc_id"), "block": rows.column("block"), "n": g.size, "entropy": entropy_of(g.size, n_log_n(counted(g.data, g.blob, g.n)).sum(1))}

    return over_groups(dealt(found.select("doc_id", "block", "chunk"), "doc_id", "block"), run, "doc_id long, block long, n long, entropy double", "chunk")


DELTAS_SQL = """deltas AS (SELECT doc_id, block, s, unnest(list_transform(range(s + 1, len(b) + 1), lambda i: (b[i] - b[i - s] + 256) % 256)) AS v
  FROM arrays, (VALUES (1), (2), (3), (4)) t(s))"""


@query(f"""WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {DELTAS_SQL}, v AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('e0', 'v')},
d AS (SELECT doc_id, block, v FROM deltas WHERE s = 1), {entropy_sql('e1', 'd')}
SELECT a.doc_id, a.block, round(a.e, 6) AS entropy, round(coalesce(b.e, 0), 6) AS delta_entropy FROM e0 a LEFT JOIN e1 b ON a.doc_id = b.doc_id AND a.block = b.block""")
def delta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each block and of the differences of its neighbouring bytes."""
    out = block_entropies(blocks(mixed_blobs(spark, sf_dir)))
    return out.select("doc_id", "block", F.round("e0", 6).alias("entropy"), F.round("e1", 6).alias("delta_entropy"))


@query(f"WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, v AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('e', 'v')} SELECT doc_id, block, round(e, 6) AS entropy FROM e WHERE e > {HIGH}")
def high_entropy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks above 7.5 bits per byte."""
    return own_entropies(blocks(mixed_blobs(spark, sf_dir))).filter(F.col("entropy") > HIGH).select("doc_id", "block", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {DELTAS_SQL}, v AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('e', 'v')},
{entropy_sql('d', 'deltas', 'doc_id, block, s')}, m AS (SELECT doc_id, block, min(e) AS least FROM d GROUP BY doc_id, block)
SELECT e.doc_id, e.block, round(e.e, 6) AS entropy, round(m.least, 6) AS least_delta_entropy, m.least >= {STRUCTURED} AS incompressible
FROM e JOIN m ON e.doc_id = m.doc_id AND e.block = m.block WHERE e.e > {HIGH}""")
def incompressible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-entropy blocks, and whether some stride shows structure."""
    high = block_entropies(blocks(mixed_blobs(spark, sf_dir))).filter(F.col("e0") > HIGH)
    return high.select("doc_id", "block", F.round("e0", 6).alias("entropy"), F.round("least", 6).alias("least_delta_entropy"), (F.col("least") >= STRUCTURED).alias("incompressible"))


def magic_label(data: Column | str) -> Column:
    """The format whose magic a blob begins with, else null; blobs of fewer than four bytes have none."""
    head = F.hex(F.substring(data, 1, 8))
    label = F.lit(None).cast("string")
    for name, prefix in reversed(MAGIC):
        label = F.when(head.rlike("^" + prefix), F.lit(name)).otherwise(label)
    return F.when(F.octet_length(data) >= 4, label)


MAGIC_SQL = "CASE WHEN length(h) < 8 THEN NULL " + " ".join(f"WHEN regexp_matches(substr(h, 1, 16), '^{p}') THEN '{n}'" for n, p in MAGIC) + " END"


@query(f"WITH {MIXED_BLOBS_SQL} SELECT doc_id, {MAGIC_SQL} AS format, substr(h, 1, 16) AS head FROM blobs")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format that each blob's first bytes name."""
    return mixed_blobs(spark, sf_dir).select("doc_id", magic_label("data").alias("format"), F.hex(F.substring("data", 1, 8)).alias("head"))


def classified(blobs: DataFrame) -> DataFrame:
    """(doc_id, block, n, e0, e1, gain, passthrough, use_delta, use_transform) of every block."""
    e = block_entropies(blocks(blobs.withColumn("magic", magic_label("data").isNotNull()), BLOCK, "magic"))
    through = F.col("magic") | ((F.col("e0") > HIGH) & (F.col("least") >= STRUCTURED))
    gain = F.col("e1") < F.col("e0") - DELTA_GAIN
    e = e.select("doc_id", "block", "n", "e0", "e1", "gain", through.alias("passthrough"), (~through & gain).alias("use_delta"))
    return e.withColumn("use_transform", ~F.col("passthrough") & ~F.col("use_delta") & (F.col("e0") < TRANSFORM_BELOW))


CLASSIFIED_SQL = f"""{MIXED_BLOBS_SQL}, {BLOCKS_SQL}, {DELTAS_SQL}, v AS (SELECT doc_id, block, unnest(b) AS v FROM arrays), {entropy_sql('e0', 'v')},
{entropy_sql('d', 'deltas', 'doc_id, block, s')},
m AS (SELECT doc_id, block, min(e) AS least, min(e) FILTER (s = 1) AS e1 FROM d GROUP BY doc_id, block),
flags AS (SELECT e0.doc_id, e0.block, CAST(e0.n AS BIGINT) AS n, e0.e AS e0, m.e1, {MAGIC_SQL} IS NOT NULL OR (e0.e > {HIGH} AND coalesce(m.least, 9) >= {STRUCTURED}) AS passthrough
  FROM e0 LEFT JOIN m ON e0.doc_id = m.doc_id AND e0.block = m.block JOIN blobs ON blobs.doc_id = e0.doc_id),
classes AS (SELECT *, NOT passthrough AND coalesce(e1 < e0 - {DELTA_GAIN}, false) AS use_delta,
  NOT passthrough AND NOT coalesce(e1 < e0 - {DELTA_GAIN}, false) AND e0 < {TRANSFORM_BELOW} AS use_transform FROM flags)"""


@query(f"WITH {CLASSIFIED_SQL} SELECT doc_id, block, n, passthrough, use_delta, use_transform FROM classes")
def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the codec would do with each block."""
    return classified(mixed_blobs(spark, sf_dir)).select("doc_id", "block", "n", "passthrough", "use_delta", "use_transform")


def sampled_share(blobs: DataFrame, step: Column, pattern: str) -> DataFrame:
    """(doc_id, size, total, hits): of every step-th byte, how many match pattern (as Latin-1 text)."""
    text = F.decode("data", "ISO-8859-1")
    # at step 1, as for all but huge blobs, no sample is drawn
    every = F.when(F.col("step") == 1, F.col("t")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.col("size") - 1) / F.col("step")), F.lit(0)).cast("int")), lambda i: F.substring(F.col("t"), (i * F.col("step") + 1).cast("int"), F.lit(1))), ""))
    rows = blobs.select("doc_id", F.octet_length("data").cast("long").alias("size"), text.alias("t")).withColumn("step", step).withColumn("s", every)
    return rows.select("doc_id", "size", F.length("s").cast("long").alias("total"), F.length(F.regexp_replace("s", f"[^{pattern}]+", "")).cast("long").alias("hits"))


#: Bytes that count as text in the two tests (fixed values): graphic ASCII and four blanks; alphanumerics, punctuation, space and line feed.
GRAPHIC, PLAIN = r"!-~ \n\r\t", r"!-~ \n"


def texty_sql(pattern: str, step: str, verdict: str) -> str:
    keep = pattern.replace("\\n", "0A").replace("\\r", "0D").replace("\\t", "09")
    blanks = [b for b, on in (("20", True), ("0A", "0A" in keep), ("0D", "0D" in keep), ("09", "09" in keep)) if on]
    return f"""WITH {MIXED_BLOBS_SQL}, a AS (SELECT doc_id, length(h) // 2 AS size, regexp_extract_all(h, '..') AS l FROM blobs),
    s AS (SELECT doc_id, size, list_filter(l, lambda x, i: (i - 1) % {step} = 0) AS l FROM a),
    c AS (SELECT doc_id, size, len(l) AS total, len(list_filter(l, lambda x: (x >= '21' AND x <= '7E') OR list_contains({blanks}, x))) AS hits FROM s)
    SELECT doc_id, size, total, hits, {verdict} AS texty FROM c"""


@query(texty_sql(GRAPHIC, "greatest(size // 65536, 1)", "total > 0 AND hits * 100 // total >= 95"))
def texty_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 95 % of a sample of bytes is printable."""
    out = sampled_share(mixed_blobs(spark, sf_dir), F.greatest(F.floor(F.col("size") / 65536), F.lit(1)), GRAPHIC)
    share = F.coalesce(F.floor(F.try_divide(F.col("hits") * 100, F.col("total"))) >= 95, F.lit(False))
    return out.select("doc_id", "size", "total", "hits", share.alias("texty"))


@query(texty_sql(PLAIN, "greatest(size // 1048576, 1)", "size >= 65536 AND hits * 100 >= total * 70"))
def texty_70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a blob of 64 KiB or more is text enough for the word dictionary."""
    out = sampled_share(mixed_blobs(spark, sf_dir), F.greatest(F.floor(F.col("size") / 1048576), F.lit(1)), PLAIN)
    return out.select("doc_id", "size", "total", "hits", ((F.col("size") >= 65536) & (F.col("hits") * 100 >= F.col("total") * 70)).alias("texty"))


def char_class(value: Column) -> Column:
    """0 letter, 1 blank, 2 digit, 3 other, of a byte value."""
    letter = value.between(65, 90) | value.between(97, 122)
    return F.when(letter, 0).when(value.isin(32, 10, 9, 13), 1).when(value.between(48, 57), 2).otherwise(3)


def byte_counts(blobs: DataFrame) -> DataFrame:
    """(b, n): how often each byte value occurs in all blobs; each task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            data, offset = bytes_of(batch.column("data"))
            n += np.bincount(data[offset[0] : offset[-1]], minlength=256)
        some = np.flatnonzero(n)
        yield {"b": some.astype(np.int32), "n": n[some]}

    cells = blobs.select("data").filter(F.octet_length("data") > 0)
    return over_batches(cells, run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))


COUNTS_SQL = "counts AS (SELECT ('0x' || x)::INT AS b, count(*) AS n FROM (SELECT unnest(regexp_extract_all(h, '..')) AS x FROM blobs) GROUP BY 1)"


@query(f"WITH {MIXED_BLOBS_SQL}, {COUNTS_SQL} SELECT b, n FROM counts")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all byte values."""
    return byte_counts(mixed_blobs(spark, sf_dir))


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {COUNTS_SQL} SELECT CASE WHEN b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 0 WHEN b IN (32, 10, 9, 13) THEN 1 WHEN b BETWEEN 48 AND 57 THEN 2 ELSE 3 END AS char_class,
count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1""")
def char_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte values of each class."""
    return byte_counts(document_blobs(spark, sf_dir)).groupBy(char_class(F.col("b")).alias("char_class")).agg(F.count("*").alias("n_values"), F.sum("n").alias("n"))


@query(f"""WITH {CLASSIFIED_SQL} SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(coalesce(sum(n) FILTER (passthrough), 0) AS BIGINT) AS passthrough_bytes,
CAST(coalesce(sum(n) FILTER (NOT passthrough), 0) AS BIGINT) AS coded_bytes, NOT bool_or(passthrough) AS plain FROM classes GROUP BY doc_id""")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each blob that are stored as they are, and that are coded."""
    c = classified(mixed_blobs(spark, sf_dir))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return c.groupBy("doc_id").agg(F.sum("n").alias("n_bytes"), part(F.col("passthrough")).alias("passthrough_bytes"), part(~F.col("passthrough")).alias("coded_bytes"), (~F.bool_or("passthrough")).alias("plain"))
