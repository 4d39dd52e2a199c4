"""Binary formats: fields written and read, headers checked into a status, hashes of contexts, bit fields, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.functions.bytes import byte_array
from bytespan.functions.workers import ship
from bytespan.registry import query
from bytespan.sources.blobs import DOCUMENT_BLOBS_SQL, document_blobs, table
from bytespan.sources.files import little_endian

#: This library's magics of a packed blob and of a solid archive, and the version that it reads.
BLOB_MAGIC, SOLID_MAGIC, VERSION, HEADER, DICTIONARY_FLAG = b"BSPB", b"BSPS", 14, 18, 4
#: Multipliers of the context hashes (fixed values).
PRIME_1, PRIME_2, MASK = 0x9E3779B1, 0x85EBCA77, 0xFFFFFFFF


def as_little_endian(value: Column, size: int) -> Column:
    """An unsigned number as size bytes, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(size)]))


def literal(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def sniffed(data: Column | str, blob: bytes = BLOB_MAGIC, solid: bytes = SOLID_MAGIC) -> Column:
    """What a file's first four bytes say that it is, and so how to read it: blob, solid or null."""
    head = F.substring(data, 1, 4)
    return F.when(head == literal(blob), "blob").when(head == literal(solid), "solid")


def header_status(data: Column | str, magic: bytes = BLOB_MAGIC, version: int = VERSION) -> Column:
    """Whether a packed blob can be read: "ok", or the first thing that is wrong. A status instead of an exception, so
    that one bad file doesn't end a job over many.

    Layout: magic, version, flags, size (8), CRC-32 (4), with a dictionary the stream's size (8), then the number of blocks
    (4), a tag for each, the size of what is stored as it is (4), and that."""
    d = F.col(data) if isinstance(data, str) else data
    n = F.octet_length(d).cast("long")
    dictionary = little_endian(d, 5, 1).bitwiseAND(F.lit(DICTIONARY_FLAG).cast("long")) != 0
    at = lambda off: F.when(n >= off + 4, little_endian(d, off, 4))
    start = F.when(dictionary, 26).otherwise(18)
    n_blocks = F.when(dictionary, at(26)).otherwise(at(18))
    tags_end = start + 4 + n_blocks
    # a field at a place that the data tell: its bytes are cut out first
    cut = F.when(n >= tags_end + 4, F.substring(d, (tags_end + 1).cast("int"), F.lit(4)))
    stored = tags_end + 4 + little_endian(cut, 0, 4)
    return (
        F.when(n < HEADER, "too short").when(F.substring(d, 1, 4) != literal(magic), "bad magic").when(little_endian(d, 4, 1) != version, "bad version")
        .when(dictionary & (n < 30), "truncated dictionary header").when(n_blocks.isNull() | (n < tags_end + 4), "truncated block table")
        .when(n < stored, "truncated stored data").otherwise("ok")
    )


def legacy_header(data: Column | str) -> Column:
    """Fields of the older header of 40 bytes, as a struct; null where the blob is shorter."""
    d = F.col(data) if isinstance(data, str) else data
    fields = (("version", 4, 1), ("level", 5, 1), ("hidden_log2", 6, 1), ("flags", 7, 1), ("original_bytes", 8, 8), ("packed_bytes", 16, 8), ("crc32", 24, 4), ("xxh3_low", 28, 4), ("region_map_bytes", 32, 4), ("file_table_offset", 36, 4))
    return F.when(F.octet_length(d) >= 40, F.struct(F.hex(F.substring(d, 1, 4)).alias("magic"), *[little_endian(d, at, size).alias(name) for name, at, size in fields]))


def regions(data: Column | str, at: int, n: Column) -> Column:
    """The n entries of a region map, six bytes each: offset and transform."""
    d = F.col(data) if isinstance(data, str) else data
    entry = lambda i: F.substring(d, F.lit(at + 1) + 6 * i, F.lit(6))
    every = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), entry)
    return F.transform(every, lambda e: F.struct(little_endian(e, 0, 4).alias("offset"), little_endian(e, 4, 1).alias("transform")))


BROKEN = 8


def made_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): a header for every document, by doc_id % BROKEN whole or broken in one of the ways that a status names."""
    d = document_blobs(spark, sf_dir)
    how, n = F.pmod("doc_id", F.lit(BROKEN)), F.octet_length("data").cast("long")
    blocks = F.floor((n + 4095) / 4096)
    head = F.concat(literal(BLOB_MAGIC), as_little_endian(F.when(how == 3, 3).otherwise(VERSION), 1), as_little_endian(F.when(how.isin(4, 7), DICTIONARY_FLAG).otherwise(1), 1), as_little_endian(n, 8), as_little_endian(F.crc32("data"), 4))
    tags = F.unhex(F.repeat(F.lit("00"), blocks.cast("int")))
    stored = F.concat(as_little_endian(F.when(how == 6, 9).otherwise(0), 4))
    whole = F.concat(head, F.when(how == 7, as_little_endian(n, 8)).otherwise(F.unhex(F.lit(""))), as_little_endian(F.when(how == 5, blocks + 5).otherwise(blocks), 4), tags, stored)
    data = F.when(how == 1, F.substring(whole, 1, 17)).when(how == 2, F.concat(literal(SOLID_MAGIC), F.substring(whole, 5, 1 << 30))).when(how == 4, F.substring(whole, 1, 29)).otherwise(whole)
    return d.select("doc_id", data.alias("data"))


def le_sql(value: str, size: int) -> str:
    return " || ".join(f"printf('%02X', (({value}) >> {8 * k}) & 255)" for k in range(size))


HEADERS_SQL = f"""{DOCUMENT_BLOBS_SQL}, sized AS (SELECT doc_id, CAST(doc_id % {BROKEN} AS INT) AS how, CAST(length(h) // 2 AS BIGINT) AS n FROM blobs),
expected AS (SELECT doc_id, n, CASE how WHEN 1 THEN 'too short' WHEN 2 THEN 'bad magic' WHEN 3 THEN 'bad version' WHEN 4 THEN 'truncated dictionary header' WHEN 5 THEN 'truncated block table' WHEN 6 THEN 'truncated stored data' ELSE 'ok' END AS status,
CASE WHEN how = 2 THEN 'solid' ELSE 'blob' END AS kind FROM sized)"""


@query(f"WITH {HEADERS_SQL} SELECT doc_id, kind, status FROM expected")
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file is, and whether it can be read."""
    return made_headers(spark, sf_dir).select("doc_id", sniffed("data").alias("kind"), header_status("data").alias("status"))


@query("SELECT doc_id, '42535042' AS magic, 3::BIGINT AS version, doc_id % 10 AS level, octet_length(encode(coalesce(text, ''))) AS original_bytes, 7 * octet_length(encode(coalesce(text, ''))) AS packed_bytes, doc_id % 3 AS n_regions, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3 - 1) * 4096 ELSE NULL END AS last_region FROM documents")
def legacy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older header and its region map, written for every document and read again."""
    d, n = document_blobs(spark, sf_dir), F.octet_length("data").cast("long")
    some = F.pmod("doc_id", F.lit(3)).cast("int")
    head = F.concat(literal(BLOB_MAGIC), as_little_endian(F.lit(3), 1), as_little_endian(F.pmod("doc_id", F.lit(10)), 1), literal(b"\0\0"), as_little_endian(n, 8), as_little_endian(7 * n, 8), as_little_endian(F.crc32("data"), 4), literal(b"\0" * 4), as_little_endian(6 * some, 4), literal(b"\0" * 4))
    entry = lambda i: F.concat(as_little_endian(F.lit(4096 * i), 4), literal(b"\1\0"))
    made = F.concat(head, F.when(some > 0, entry(0)).otherwise(literal(b"")), F.when(some > 1, entry(1)).otherwise(literal(b"")))
    rows = d.select("doc_id", made.alias("data")).select("doc_id", "data", legacy_header("data").alias("h"))
    rows = rows.select("doc_id", "h", regions("data", 40, (F.col("h.region_map_bytes") / 6).cast("int")).alias("r"))
    last = F.when(F.size("r") > 0, F.element_at("r", -1)["offset"])
    return rows.select("doc_id", "h.magic", "h.version", "h.level", "h.original_bytes", "h.packed_bytes", F.size("r").cast("long").alias("n_regions"), last.alias("last_region"))


# hashes

def times(x: Column, prime: int) -> Column:
    """x * prime modulo 2**32 for x below 2**32, on two halves of 16 bits: no product exceeds a long."""
    low = x.bitwiseAND(F.lit(0xFFFF).cast("long")) * prime
    high = F.shiftleft((F.shiftright(x, 16) * prime).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def folded(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 15))


def hash_ctx(values: Column, salt: int) -> Column:
    """The 32-bit hash of a context, an array of bytes, with the salt of its model."""
    start = F.lit((salt * PRIME_1 + 0x12345678) & MASK).cast("long")
    return F.aggregate(values, start, lambda h, b: folded(times(h.bitwiseXOR(b.cast("long") + 1), PRIME_1)))


def suffix_hash(values: Column, n: int) -> Column:
    """The 32-bit hash of the last n bytes of an array, salted by n; null where there are fewer."""
    start = F.lit(0x811C9DC5 ^ (n * PRIME_2 & MASK)).cast("long")
    last = F.slice(values, F.size(values) - n + 1, n)
    return F.when(F.size(values) >= n, folded(F.aggregate(last, start, lambda h, b: times(h.bitwiseXOR(b.cast("long")), PRIME_1))))


def hash_sql(values: str, start: int, plus: int, fold: bool) -> str:
    step = f"(xor(h, b + {plus})::HUGEINT * {PRIME_1} % 4294967296)::BIGINT"
    step = f"xor({step}, {step} >> 15)" if fold else step
    return f"list_reduce({values}, lambda h, b: {step}, {start}::BIGINT)"


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, l AS (SELECT doc_id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM blobs), s AS (SELECT doc_id, b[len(b) - 2 :] AS b3, b[len(b) - 3 :] AS b4, b[len(b) - 7 :] AS b8, len(b) AS n FROM l),
f AS (SELECT doc_id, n, {hash_sql('b3', (5 * PRIME_1 + 0x12345678) & MASK, 1, True)} AS c3, {hash_sql('b4', 0x811C9DC5 ^ (4 * PRIME_2 & MASK), 0, False)} AS s4, {hash_sql('b8', 0x811C9DC5 ^ (8 * PRIME_2 & MASK), 0, False)} AS s8 FROM s WHERE n >= 8)
SELECT doc_id, c3 AS context3, xor(s4, s4 >> 15) AS suffix4, xor(s8, s8 >> 15) AS suffix8 FROM f""")
def context_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that context tables and match tables are addressed by, at the end of every document of eight bytes or more."""
    rows = document_blobs(spark, sf_dir).filter(F.octet_length("data") >= 8).select("doc_id", byte_array(F.substring(F.col("data"), F.octet_length("data") - 7, F.lit(8))).alias("b"))
    return rows.select("doc_id", hash_ctx(F.slice("b", 6, 3), 5).alias("context3"), suffix_hash(F.col("b"), 4).alias("suffix4"), suffix_hash(F.col("b"), 8).alias("suffix8"))


# bit fields

def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of up to 56 bits one after another, each and every byte from its lowest bit on."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    place = np.repeat(np.cumsum(widths) - widths, widths)
    k = np.arange(widths.sum()) - place
    return np.packbits((np.repeat(values, widths) >> k.astype(np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, widths: np.ndarray) -> np.ndarray:
    """The fields again. Widths beyond the data are an error."""
    widths = np.asarray(widths, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if widths.sum() > len(bits):
        raise ValueError("fields beyond the end of the data")
    ends = np.cumsum(widths)
    k = np.arange(widths.sum()) - np.repeat(ends - widths, widths)
    part = bits[: widths.sum()].astype(np.uint64) << k.astype(np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
    return total[ends] - total[ends - widths]


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, l AS (SELECT doc_id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::INT) AS b FROM blobs)
SELECT doc_id, CAST(len(b) AS BIGINT) AS n_fields, CAST(ceil(coalesce(list_sum(list_transform(b, lambda x: 1 + CASE WHEN x = 0 THEN 0 ELSE CAST(floor(log2(x)) AS INT) END)), 0) / 8) AS BIGINT) AS packed_bytes, true AS same FROM l""")
def bits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as bit fields of their own width, and whether they return."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for raw in frame["data"]:
                b = np.frombuffer(bytes(raw), np.uint8)
                widths = np.frexp(np.maximum(b, 1).astype(float))[1]
                packed = pack_bits(b, widths)
                out.append((len(b), len(packed), bool((unpack_bits(packed, widths) == b).all())))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_fields": [x[0] for x in out], "packed_bytes": [x[1] for x in out], "same": [x[2] for x in out]})

    return document_blobs(spark, sf_dir).mapInPandas(run, "doc_id long, n_fields long, packed_bytes long, same boolean")


@query()
def xxh3_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH3 (64 bits, as hex) of every document; Spark's own xxhash64 is another function."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "xxh3": [xxhash.xxh3_64_hexdigest(bytes(d)) for d in frame["data"]]})

    return document_blobs(spark, sf_dir).mapInPandas(run, "doc_id long, xxh3 string")


# listings

def in_listing_order(entries: DataFrame, *folder: str) -> DataFrame:
    """Entries with is_dir and name as a listing shows them: directories first, then by lower-case name."""
    return entries.orderBy(*folder, F.desc("is_dir"), F.lower("name"), "name")


@query("""WITH e AS (SELECT lang AS folder, source AS name, true AS is_dir, 0::BIGINT AS size FROM documents GROUP BY ALL
UNION ALL SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'Doc' ELSE 'doc' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.PACKED' ELSE '.txt' END, false, octet_length(encode(coalesce(text, ''))) FROM documents)
SELECT folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, lower(name), name) AS INT) AS place, name, is_dir, lower(name) LIKE '%.packed' AS is_archive, size FROM e""")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of an archive tree (languages) as listings: sources as directories, documents as files."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, "Doc").otherwise("doc"), F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(5)) == 0, ".PACKED").otherwise(".txt"))
    files = d.select(F.col("lang").alias("folder"), name.alias("name"), F.lit(False).alias("is_dir"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    folders = d.select(F.col("lang").alias("folder"), F.col("source").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size")).distinct()
    rows = files.unionByName(folders)
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("is_dir"), F.lower("name"), "name"))
    return rows.select("folder", place.alias("place"), "name", "is_dir", F.lower("name").endswith(".packed").alias("is_archive"), "size")
