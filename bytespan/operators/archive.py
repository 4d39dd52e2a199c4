"""Archives as tables: catalog, offsets, packing, unpacking, selection, checksums, reports.

An archive is all documents of one source, members in the order of their ids.
The payload is stored in parts of PART bytes' worth of members, so no archive,
however large, has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytespan.functions.bytes import byte_array
from bytespan.operators.transforms import COST_BITS, GAINS_SQL, block_tags
from bytespan.operators.profile import CLASSIFIED_SQL
from bytespan.registry import query
from bytespan.sources.blobs import DOCUMENT_BLOBS_SQL, document_blobs, mixed_blobs, table

PART = 1 << 16
#: Ids in a range whose members' sizes are summed by one task.
RANGE = 1 << 16
MEMBERS_SQL = f"""members AS (SELECT source AS archive, doc_id, lang || '/' || doc_id AS name, hex(encode(coalesce(text, ''))) AS h FROM documents),
catalog AS (SELECT archive, doc_id, name, h, length(h) // 2 AS size, CAST(coalesce(sum(length(h) // 2) OVER (PARTITION BY archive ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(row_number() OVER (PARTITION BY archive ORDER BY doc_id) - 1 AS INT) AS ordinal FROM members)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive, doc_id, name, data)."""
    name = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("archive"), "doc_id", name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def catalog(found: DataFrame) -> DataFrame:
    """(archive, ordinal, doc_id, name, size, offset): offsets are running sums of sizes; payloads are not read.

    Sums are taken in two levels, so that an archive of any number of members is no task's alone: ids are cut into
    ranges of RANGE, of which the sums run over the ranges of an archive, and the members of each range are summed by
    themselves."""
    rows = found.select("archive", "doc_id", "name", F.octet_length("data").cast("long").alias("size")).withColumn("range", F.floor(F.col("doc_id") / RANGE))
    ranges = Window.partitionBy("archive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("archive", "range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = lambda c: F.coalesce(F.sum(c).over(ranges), F.lit(0))
    sums = sums.select("archive", "range", before("n").alias("n_before"), before("bytes").alias("bytes_before"))
    order = Window.partitionBy("archive", "range").orderBy("doc_id")
    offset = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("archive", "range", "doc_id", "name", "size", (F.row_number().over(order) - 1).alias("i"), offset.alias("o")).join(sums, ["archive", "range"])
    return rows.select("archive", (F.col("n_before") + F.col("i")).cast("int").alias("ordinal"), "doc_id", "name", "size", (F.col("bytes_before") + F.col("o")).alias("offset"))


@query(f'WITH {MEMBERS_SQL} SELECT archive, ordinal, doc_id, "offset" FROM catalog')
def archive_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each member begins."""
    return catalog(members(spark, sf_dir)).select("archive", "ordinal", "doc_id", "offset")


@query(f"WITH {MEMBERS_SQL} SELECT archive, ordinal, name, size FROM catalog")
def archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in archive order."""
    return catalog(members(spark, sf_dir)).select("archive", "ordinal", "name", "size")


@query(f"WITH {MEMBERS_SQL} SELECT archive, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS n_bytes, round(sum(size) / greatest(count(*), 1), 6) AS mean_size FROM catalog GROUP BY archive")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and bytes of each archive."""
    rows = members(spark, sf_dir).groupBy("archive").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("data")).alias("n_bytes"))
    return rows.withColumn("mean_size", F.round(F.col("n_bytes") / F.greatest("n_members", F.lit(1)), 6))


def packed(found: DataFrame) -> DataFrame:
    """(archive, part, start, payload): members joined end to end, in parts by where they begin."""
    rows = found.join(catalog(found).select("archive", "doc_id", "offset"), ["archive", "doc_id"])
    parts = rows.groupBy("archive", F.floor(F.col("offset") / PART).alias("part")).agg(F.min("offset").alias("start"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "data"))).alias("m"))
    payload = F.aggregate("m", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"]))
    return parts.select("archive", "part", "start", F.size("m").cast("long").alias("n_members"), payload.alias("payload"))


@query(f"""WITH {MEMBERS_SQL} SELECT archive, "offset" // {PART} AS part, min("offset") AS start, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS n_bytes,
sha256(unhex(string_agg(h, '' ORDER BY "offset", doc_id))) AS digest FROM catalog GROUP BY archive, part""")
def archive_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each archive's payload."""
    return packed(members(spark, sf_dir)).select("archive", "part", "start", "n_members", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))


@query(f"WITH {MEMBERS_SQL} SELECT archive, name, size, sha256(unhex(h)) AS digest, true AS same FROM catalog")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member cut out of the packed payload again, and whether it is what went in."""
    found = members(spark, sf_dir)
    rows = catalog(found).withColumn("part", F.floor(F.col("offset") / PART)).join(packed(found).drop("n_members"), ["archive", "part"])
    cut = F.substring(F.col("payload"), (F.col("offset") - F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    rows = rows.select("archive", "doc_id", "name", "size", cut.alias("cut")).join(found.select("archive", "doc_id", "data"), ["archive", "doc_id"])
    return rows.select("archive", "name", "size", F.sha2("cut", 256).alias("digest"), (F.col("cut") == F.col("data")).alias("same"))


@query(f"""WITH {CLASSIFIED_SQL}, {GAINS_SQL}, tags AS (SELECT c.doc_id, passthrough, use_transform AND coalesce(g.gain > {COST_BITS}, false) AS moved FROM classes c LEFT JOIN gains g ON c.doc_id = g.doc_id AND c.block = g.block AND g.tag = 1)
SELECT doc_id, count(*) AS n_blocks, CASE WHEN bool_or(passthrough) THEN 1 ELSE 0 END + CASE WHEN bool_or(moved) THEN 2 ELSE 0 END AS flags FROM tags GROUP BY doc_id""")
def archive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that each blob's header gets: 1 something is stored as it is, 2 something is transformed."""
    tags = block_tags(mixed_blobs(spark, sf_dir))
    flag = F.when(F.col("tag") == 255, 1).when(F.col("tag") > 0, 2).otherwise(0)
    return tags.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.bit_or(flag).alias("flags"))


@query(f"""WITH {MEMBERS_SQL} SELECT archive, 14 AS version, count(*) AS n_members, CAST(sum(size) AS BIGINT) AS original_bytes, CAST((sum(size) + 4095) // 4096 AS BIGINT) AS n_blocks,
CAST((sum(size) + 16777215) // 16777216 AS BIGINT) AS n_segments, max(size) AS largest FROM catalog GROUP BY archive""")
def archive_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive's header tells."""
    rows = members(spark, sf_dir).groupBy("archive").agg(F.count("*").alias("n_members"), F.sum(F.octet_length("data")).alias("original_bytes"), F.max(F.octet_length("data")).cast("long").alias("largest"))
    up = lambda n: F.floor((F.col("original_bytes") + n - 1) / n)
    return rows.select("archive", F.lit(14).alias("version"), "n_members", "original_bytes", up(4096).alias("n_blocks"), up(1 << 24).alias("n_segments"), "largest")


@query(f"WITH {MEMBERS_SQL} SELECT archive, name, size FROM catalog WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are wanted (labelled toxic): a semi-join prunes them before their payload is decoded."""
    wanted = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return members(spark, sf_dir).join(wanted, "doc_id", "left_semi").select("archive", "name", F.octet_length("data").cast("long").alias("size"))


@query("SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents")
def selection_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected ids that are present."""
    return table(spark, sf_dir, "labels").select("doc_id").intersect(table(spark, sf_dir, "documents").select("doc_id"))


CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crcs AS (SELECT doc_id, length(h) // 2 AS n, CASE WHEN h = '' THEN 0 ELSE xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INT)]), 4294967295::BIGINT), 4294967295) END AS crc FROM blobs, crc_table)"""


@query(f"WITH {DOCUMENT_BLOBS_SQL}, {CRC_SQL} SELECT doc_id, n, crc FROM crcs")
def crc32_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of every document."""
    return document_blobs(spark, sf_dir).select("doc_id", F.octet_length("data").cast("long").alias("n"), F.crc32("data").alias("crc"))


@query(f"WITH {MEMBERS_SQL}, blobs AS (SELECT doc_id, h FROM members), {CRC_SQL} SELECT c.doc_id, c.crc, c.crc AS stored, true AS same FROM crcs c")
def verify_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each member as cut out of the archive, against that of the document."""
    found = members(spark, sf_dir)
    rows = catalog(found).withColumn("part", F.floor(F.col("offset") / PART)).join(packed(found).select("archive", "part", "start", "payload"), ["archive", "part"])
    cut = F.substring(F.col("payload"), (F.col("offset") - F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    stored = found.select("archive", "doc_id", F.crc32("data").alias("stored"))
    return rows.select("archive", "doc_id", F.crc32(cut).alias("crc")).join(stored, ["archive", "doc_id"]).select("doc_id", "crc", "stored", (F.col("crc") == F.col("stored")).alias("same"))


def fnv1a(data: Column | str) -> Column:
    """64-bit FNV-1a as hex, on two halves of 32 bits: no product exceeds a long."""
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    def step(a: Column, b: Column) -> Column:
        lo = a["lo"].bitwiseXOR(b.cast("long"))
        low = lo * 435
        high = (a["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), low.bitwiseAND(mask).alias("lo"))
    return F.aggregate(byte_array(data), start, step, lambda a: F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0")))


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, f AS (SELECT doc_id, CASE WHEN h = '' THEN 14695981039346656037::HUGEINT ELSE list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::HUGEINT),
lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) END AS f FROM blobs) SELECT doc_id, upper(lpad(to_hex(f::UBIGINT), 16, '0')) AS fnv FROM f""")
def fnv1a_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit FNV-1a of every document."""
    return document_blobs(spark, sf_dir).select("doc_id", fnv1a("data").alias("fnv"))


@query("""WITH d AS (SELECT sha256(encode(coalesce(text, ''))) AS digest, octet_length(encode(coalesce(text, ''))) AS n, doc_id FROM documents)
SELECT digest, n, count(*) AS copies, min(doc_id) AS first_id FROM d GROUP BY digest, n HAVING count(*) > 1""")
def duplicate_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents (the checksums' natural use)."""
    rows = document_blobs(spark, sf_dir).select(F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("n"), "doc_id")
    return rows.groupBy("digest", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(f"""WITH {MEMBERS_SQL}, p AS (SELECT archive, doc_id, h, unnest(regexp_extract_all(h, '..')) AS b FROM members), c AS (SELECT archive, doc_id, b, count(*) AS c FROM p GROUP BY ALL),
e AS (SELECT archive, doc_id, sum(c) AS n, ceil((sum(c) * log2(sum(c)) - sum(c * log2(c))) / 8 - 1e-9) AS coded FROM c GROUP BY ALL)
SELECT CASE WHEN grouping(archive) = 1 THEN 'TOTAL' ELSE archive END AS file, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(coded) AS BIGINT) AS coded_bytes, round(sum(coded) / greatest(sum(n), 1), 6) AS ratio, round(sum(coded) * 8 / greatest(sum(n), 1), 6) AS bits_per_byte
FROM e GROUP BY ROLLUP (archive)""")
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, order-0 coded bytes and ratios per archive, and in all: one rollup."""
    rows = members(spark, sf_dir).repartition("archive", "doc_id").select("archive", "doc_id", F.explode(byte_array("data")).alias("b"))
    counts = rows.groupBy("archive", "doc_id", "b").agg(F.count("*").alias("c"))
    n = F.sum("c").cast("double")
    by = counts.groupBy("archive", "doc_id").agg(F.sum("c").alias("n"), F.ceil((n * F.log2(n) - F.sum(F.col("c") * F.log2(F.col("c").cast("double")))) / 8 - 1e-9).alias("coded"))
    out = by.rollup("archive").agg(F.grouping("archive").alias("g"), F.sum("n").alias("n_bytes"), F.sum("coded").alias("coded_bytes"))
    ratio = F.col("coded_bytes") / F.greatest("n_bytes", F.lit(1))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("archive")).alias("file"), "n_bytes", "coded_bytes", F.round(ratio, 6).alias("ratio"), F.round(ratio * 8, 6).alias("bits_per_byte"))
