"""Files: catalogs of a folder tree, sizes, sniffing, names, and sinks. Paths go to Spark's readers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.registry import query
from bytespan.sources.blobs import table

def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, relative, name, size, modified) of a folder's files, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    root = path.rstrip("/").split("://")[-1] + "/"
    relative = F.substring_index("path", root, -1)
    rows = files.select("path", relative.alias("relative"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.orderBy("name", "relative")


def directory(spark: SparkSession, path: str, archives: tuple[str, ...] = (".packed",)) -> DataFrame:
    """(name, is_dir, is_archive, size, modified) of what a folder holds, directories first, then by lower-case name. Object
    stores have no directories but those that their files' names tell, so empty ones are not seen."""
    top = F.substring_index("relative", "/", 1)
    rows = listing(spark, path).groupBy(top.alias("name")).agg(F.max(F.col("relative").contains("/")).alias("is_dir"), F.sum("size").alias("size"), F.max("modified").alias("modified"))
    packed = F.lit(False)
    for extension in archives:
        packed = packed | F.lower("name").endswith(extension)
    return rows.select("name", "is_dir", (packed & ~F.col("is_dir")).alias("is_archive"), F.when(F.col("is_dir"), 0).otherwise(F.col("size")).alias("size"), "modified").orderBy(F.desc("is_dir"), F.lower("name"), "name")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, data) of a folder tree, or of one file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))


def total_size(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of size bytes at a place (from 0)."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, F.lit(1))), 16, 10).cast("long")
    return sum((byte(i) * (1 << 8 * i) for i in range(1, size)), byte(0))


def header(data: Column | str) -> Column:
    """Fields of an archive header: magic, version, flags, original size, CRC-32; null where the blob is too short."""
    d = F.col(data) if isinstance(data, str) else data
    fields = F.struct(F.decode(F.substring(d, 1, 4), "ISO-8859-1").alias("magic"), little_endian(d, 4, 1).alias("version"), little_endian(d, 5, 1).alias("flags"), little_endian(d, 6, 8).alias("original_bytes"), little_endian(d, 14, 4).alias("crc32"))
    return F.when(F.octet_length(d) >= 18, fields)


def safe_path(name: Column | str) -> Column:
    """A member name as a relative path: no root, no empty, "." or ".." parts; "file" if nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(name, r"\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("file"))


def packed_name(name: Column | str, extension: str = ".packed") -> Column:
    return F.concat(name, F.lit(extension))


def unpacked_name(name: Column | str, extension: str = ".packed") -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.endswith(extension), F.substring(n, F.lit(1), F.length(n) - len(extension))).otherwise(F.concat(n, F.lit(".out")))


def write_archive(packed: DataFrame, path: str) -> None:
    """Archive parts as Parquet, partitioned by archive, so that reading one prunes the others."""
    packed.write.mode("overwrite").partitionBy("archive").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


@query("""WITH n AS (SELECT doc_id, '/' || lang || '/../' || source || '//./' || doc_id || CASE WHEN lang = 'en' THEN '.packed' ELSE '' END AS name FROM documents)
SELECT doc_id, lang || '/' || source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.packed' ELSE '' END AS safe, name || '.packed' AS packed_name,
CASE WHEN lang = 'en' THEN left(name, length(name) - 7) ELSE name || '.out' END AS unpacked_name FROM n JOIN documents USING (doc_id)""")
def member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsafe member names made safe, and the default names of packed and unpacked files."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("/"), "lang", F.lit("/../"), "source", F.lit("//./"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".packed").otherwise(""))
    return d.select("doc_id", name.alias("name")).select("doc_id", safe_path("name").alias("safe"), packed_name("name").alias("packed_name"), unpacked_name("name").alias("unpacked_name"))


UNITS = ("B", "KB", "MB", "GB")


def human_size(n: Column | str) -> tuple[Column, Column]:
    """A size as an amount and a unit: bytes below 1024, then KB, MB and GB. The number stays a number, since engines
    differ in how they round one into text."""
    n = F.col(n) if isinstance(n, str) else n
    amount, unit = n.cast("double"), F.lit(UNITS[0])
    for k, name in enumerate(UNITS[1:], 1):
        amount, unit = F.when(n >= 1024**k, F.round(n / F.lit(float(1024**k)), 6)).otherwise(amount), F.when(n >= 1024**k, name).otherwise(unit)
    return amount, unit


@query("""WITH s AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) * (1::BIGINT << CAST(10 * (doc_id % 4) AS INT)) AS n FROM documents)
SELECT doc_id, n AS n_bytes, CASE WHEN n >= 1073741824 THEN round(n / 1073741824.0::DOUBLE, 6) WHEN n >= 1048576 THEN round(n / 1048576.0::DOUBLE, 6) WHEN n >= 1024 THEN round(n / 1024.0::DOUBLE, 6) ELSE n::DOUBLE END AS amount,
CASE WHEN n >= 1073741824 THEN 'GB' WHEN n >= 1048576 THEN 'MB' WHEN n >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM s""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes (of documents, times 1024 up to three times) as an amount and a unit."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.pow(F.lit(1024.0), F.pmod("doc_id", F.lit(4))).cast("long")
    amount, unit = human_size("n_bytes")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes")).withColumn("amount", amount).withColumn("unit", unit)


@query()
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files under the data folder: relative path, name, size."""
    return listing(spark, sf_dir).select("relative", "name", "size")
