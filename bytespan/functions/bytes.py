"""Column functions over binary cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def byte_array(data: Column | str) -> Column:
    """The bytes of a binary cell as array<int>: decoded as Latin-1, each character is a byte."""
    text = F.decode(data, "ISO-8859-1")
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def blocks(blobs: DataFrame, size: int = BLOCK, *carried: str) -> DataFrame:
    """(doc_id, block, chunk, n), and the columns carried: windows of size bytes, the last one shorter; an empty blob has
    none."""
    length = F.octet_length("data")
    # chunks are cut before the explode, so that no row of a block carries the blob
    chunks = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int")), lambda k: F.substring(F.col("data"), k * size + 1, F.lit(size)))
    rows = blobs.filter(length > 0).select("doc_id", *carried, F.posexplode(chunks).alias("block", "chunk"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), "chunk", F.octet_length("chunk").cast("long").alias("n"), *carried)


#: Bytes of a blob whose windows are formed at once: no row ever holds all windows of a large blob.
SLICE = 1 << 16


def windows(blobs: DataFrame, order: int) -> DataFrame:
    """(doc_id, p, key): for every byte, at place p from 0, the order bytes before it (zeros before the start) and itself.

    A blob is first cut into slices that overlap by order bytes; blobs are dealt out once by id."""
    n = F.octet_length("data")
    padded = F.concat(F.unhex(F.lit("00" * order)), F.col("data")) if order else F.col("data")
    rows = blobs.filter(n > 0).repartition("doc_id").select("doc_id", padded.alias("d"), n.alias("n"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SLICE).cast("int")), lambda k: F.substring(F.col("d"), k * SLICE + 1, F.lit(SLICE + order)))
    rows = rows.select("doc_id", F.posexplode(slices).alias("k", "s"))
    keys = F.transform(F.sequence(F.lit(1), F.octet_length("s") - order), lambda p: F.substring(F.col("s"), p, F.lit(order + 1)))
    return rows.select("doc_id", "k", F.posexplode(keys).alias("p", "key")).select("doc_id", (F.col("k").cast("long") * SLICE + F.col("p")).alias("p"), "key")


def delta(array: Column, stride: int = 1) -> Column:
    """Differences modulo 256 of bytes stride apart, one for each byte that has a predecessor."""
    return F.transform(F.slice(array, stride + 1, 1 << 30), lambda x, i: F.pmod(x - F.get(array, i), F.lit(256)))


def entropy(counts: Column) -> Column:
    """Aggregate over the rows of a histogram: bits per byte."""
    n = F.sum(counts).cast("double")
    return F.greatest(F.lit(0.0), F.log2(n) - F.sum(counts * F.log2(counts.cast("double"))) / n)


def lgamma2(x: Column) -> Column:
    """Base-2 logarithm of the gamma function for x >= 1: Stirling's series at x + 8, stepped back."""
    y = x + 8.0
    inv = 1.0 / y
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    big = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + float(k))
    return (big - steps) / math.log(2)
