"""Vocabulary mining and dictionary tokenisation over a corpus of blobs.

Words are counted, ranked and numbered with relational operators; the dictionary
is at most 24 + 40 x 256 words whatever the corpus, so it may be broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytespan.functions.groups import bytes_of, dealt, over_batches
from bytespan.operators.profile import COUNTS_SQL, byte_counts
from bytespan.registry import query
from bytespan.sources.blobs import DOCUMENT_BLOBS_SQL, document_blobs, table

#: Limits of the dictionary (fixed values).
MIN_WORD, MAX_WORD, MIN_COUNT, MIN_SAVED, MIN_WORDS, MAX_SINGLE, MAX_LEAD, MIN_UNUSED = 3, 40, 8, 64, 16, 24, 40, 12
#: A candidate: an optional space and a run of ASCII letters and digits.
RUN = "( ?[A-Za-z0-9]+)"


@query(f"WITH {DOCUMENT_BLOBS_SQL}, {COUNTS_SQL} SELECT CAST(b AS INT) AS b FROM range(256) r(b) WHERE b NOT IN (SELECT b FROM counts)")
def unused_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte values that occur in no document."""
    used = byte_counts(document_blobs(spark, sf_dir)).select("b")
    return spark.range(256).select(F.col("id").cast("int").alias("b")).join(used, "b", "left_anti")


ALPHABET_SQL = f"""unused AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS u FROM range(256) r(b) WHERE b NOT IN (SELECT b FROM counts)),
sizes AS (SELECT u, least({MAX_SINGLE}, greatest(greatest(u - {MAX_LEAD}, 0), u // 3)) AS n_single FROM (SELECT coalesce(max(u), 0) AS u FROM unused)),
alphabet AS (SELECT u AS n_unused, n_single, least(u - n_single, {MAX_LEAD}) AS n_lead FROM sizes)"""


def alphabet(unused: DataFrame) -> DataFrame:
    """One row: n_unused, n_single, n_lead, capacity, usable."""
    n = unused.agg(F.count("*").alias("n_unused"))
    n = n.withColumn("n_single", F.least(F.lit(MAX_SINGLE), F.greatest(F.greatest(F.col("n_unused") - MAX_LEAD, F.lit(0)), F.floor(F.col("n_unused") / 3))).cast("long"))
    n = n.withColumn("n_lead", F.least(F.col("n_unused") - F.col("n_single"), F.lit(MAX_LEAD)).cast("long"))
    return n.withColumn("capacity", F.col("n_single") + 256 * F.col("n_lead")).withColumn("usable", F.col("n_unused") >= MIN_UNUSED)


@query(f"WITH {DOCUMENT_BLOBS_SQL}, {COUNTS_SQL}, {ALPHABET_SQL} SELECT n_unused, n_single, n_lead, n_single + 256 * n_lead AS capacity, n_unused >= {MIN_UNUSED} AS usable FROM alphabet")
def token_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unused byte values are shared out to one- and two-byte tokens."""
    return alphabet(unused_bytes(spark, sf_dir))


def counted_words(texts: DataFrame) -> DataFrame:
    """(word, n) of candidate runs of 3 to 40 bytes."""
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("word"))
    return runs.filter(F.length("word").between(MIN_WORD, MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


WORDS_SQL = f"words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS word FROM documents) WHERE length(word) BETWEEN {MIN_WORD} AND {MAX_WORD} GROUP BY word)"


@query(f"WITH {WORDS_SQL} SELECT word, n FROM words")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each candidate word is spelled."""
    return counted_words(table(spark, sf_dir, "documents"))


def candidates(words: DataFrame) -> DataFrame:
    saved = (F.length("word") - 2) * F.col("n")
    return words.filter((F.col("n") >= MIN_COUNT) & (saved > MIN_SAVED)).withColumn("saved", saved)


CANDIDATES_SQL = f"{WORDS_SQL}, candidates AS (SELECT word, n, (length(word) - 2) * n AS saved FROM words WHERE n >= {MIN_COUNT} AND (length(word) - 2) * n > {MIN_SAVED})"


@query(f"WITH {CANDIDATES_SQL} SELECT word, n, saved FROM candidates")
def dict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat often enough to save bytes."""
    return candidates(word_counts(spark, sf_dir))


def dictionary(words: DataFrame, letters: DataFrame) -> DataFrame:
    """(idx, word, n, kind) in dictionary order. words: dict_candidates; letters: one row of alphabet().

    The first cut is a limit, of which each task sends no more than its own best, so the windows after it see as many words
    as a dictionary can hold, whatever the vocabulary."""
    byte_order = F.encode("word", "UTF-8")
    best = Window.orderBy(F.desc("saved"), byte_order)
    limit = MAX_SINGLE + 256 * MAX_LEAD
    ranked = words.orderBy(F.desc("saved"), byte_order).limit(limit).withColumn("r", F.row_number().over(best))
    ranked = ranked.crossJoin(F.broadcast(letters)).filter(F.col("usable") & (F.col("r") <= F.col("capacity")))
    enough = ranked.agg((F.count("*") >= MIN_WORDS).alias("enough"))
    head = F.when(F.col("r") <= 4 * F.col("n_single"), 0).otherwise(1)
    spelled = F.when(F.col("r") <= 4 * F.col("n_single"), (F.length("word") - 1) * F.col("n")).otherwise(-F.col("r"))
    ranked = ranked.withColumn("r2", F.row_number().over(Window.orderBy(head, F.desc(spelled), byte_order)))
    single = F.col("r2") <= F.col("n_single")
    third = Window.orderBy(F.when(single, 0).otherwise(1), F.when(single, F.col("r2")), byte_order)
    out = ranked.withColumn("idx", F.row_number().over(third) - 1).crossJoin(F.broadcast(enough)).filter("enough")
    return out.select("idx", "word", "n", F.when(F.col("idx") < F.col("n_single"), "single").otherwise("pair").alias("kind"))


DICTIONARY_SQL = f"""{DOCUMENT_BLOBS_SQL}, {COUNTS_SQL}, {ALPHABET_SQL}, {CANDIDATES_SQL},
first AS (SELECT word, n, row_number() OVER (ORDER BY saved DESC, encode(word)) AS r, a.* FROM candidates, alphabet a WHERE n_unused >= {MIN_UNUSED}),
kept AS (SELECT * FROM first WHERE r <= n_single + 256 * n_lead),
second AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r <= 4 * n_single THEN 0 ELSE 1 END, CASE WHEN r <= 4 * n_single THEN -(length(word) - 1) * n ELSE r END, encode(word)) AS r2 FROM kept),
dict AS (SELECT CAST(row_number() OVER (ORDER BY CASE WHEN r2 <= n_single THEN 0 ELSE 1 END, CASE WHEN r2 <= n_single THEN r2 END, encode(word)) - 1 AS INT) AS idx, word, n, n_single, n_lead FROM second
  WHERE (SELECT count(*) FROM kept) >= {MIN_WORDS})"""


@query(f"WITH {DICTIONARY_SQL} SELECT idx, word, n, CASE WHEN idx < n_single THEN 'single' ELSE 'pair' END AS kind FROM dict")
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus dictionary, in token order."""
    return dictionary(dict_candidates(spark, sf_dir), token_alphabet(spark, sf_dir))


def tokenised(runs: DataFrame, words: DataFrame) -> DataFrame:
    """runs (run, ...) with the dictionary index of the run, or of its bare word, and how it was found.

    Both probes are broadcast hash joins: the dictionary's size is bounded by its alphabet."""
    d = words.select(F.col("word").alias("w"), F.col("idx").alias("i"))
    whole, bare = F.broadcast(d.select(F.col("w").alias("w1"), F.col("i").alias("i1"))), F.broadcast(d.select(F.col("w").alias("w2"), F.col("i").alias("i2")))
    out = runs.join(whole, F.col("run") == F.col("w1"), "left").join(bare, (F.substring("run", 2, 1 << 20) == F.col("w2")) & F.col("run").startswith(" "), "left")
    fit = F.length("run") <= MAX_WORD
    how = F.when(fit & F.col("i1").isNotNull(), "whole").when(fit & F.col("i2").isNotNull(), "bare").otherwise("plain")
    return out.withColumn("how", how).withColumn("idx", F.when(F.col("how") == "whole", F.col("i1")).when(F.col("how") == "bare", F.col("i2"))).drop("w1", "i1", "w2", "i2")


@query(f"""WITH {DICTIONARY_SQL}, runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM documents),
found AS (SELECT r.doc_id, r.run, CASE WHEN length(run) > {MAX_WORD} THEN 'plain' WHEN a.idx IS NOT NULL THEN 'whole' WHEN b.idx IS NOT NULL THEN 'bare' ELSE 'plain' END AS how,
  coalesce(a.idx, b.idx) AS idx, coalesce(a.n_single, b.n_single) AS n_single
  FROM runs r LEFT JOIN dict a ON r.run = a.word LEFT JOIN dict b ON r.run[1] = ' ' AND r.run[2:] = b.word)
SELECT doc_id, count(*) AS n_runs, count(*) FILTER (how = 'whole') AS n_whole, count(*) FILTER (how = 'bare') AS n_bare, count(*) FILTER (how = 'plain') AS n_plain,
CAST(sum(CASE how WHEN 'plain' THEN length(run) WHEN 'whole' THEN 0 ELSE 1 END + CASE WHEN how = 'plain' THEN 0 WHEN idx < n_single THEN 1 ELSE 2 END) AS BIGINT) AS coded_bytes FROM found GROUP BY doc_id""")
def dict_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's words are tokenised by the corpus dictionary, and the bytes that they then take."""
    words = dictionary_build(spark, sf_dir)
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run"))
    found = tokenised(runs, words.select("word", F.when(F.col("kind") == "single", F.col("idx")).otherwise(F.col("idx") + 1_000_000).alias("idx")))
    size = F.when(F.col("how") == "plain", F.length("run")).otherwise(F.when(F.col("how") == "bare", 1).otherwise(0) + F.when(F.col("idx") < 1_000_000, 1).otherwise(2))
    n = lambda how: F.count(F.when(F.col("how") == how, 1))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_runs"), n("whole").alias("n_whole"), n("bare").alias("n_bare"), n("plain").alias("n_plain"), F.sum(size).alias("coded_bytes"))


class Codec:
    """A dictionary's tokens, for any number of blobs."""

    def __init__(self, words: list[str], unused: list[int], n_single: int):
        token = lambda i: bytes([unused[i]]) if i < n_single else bytes([unused[n_single + (i - n_single) // 256], (i - n_single) % 256])
        self.tokens = {w.encode(): token(i) for i, w in enumerate(words) if len(w.encode()) <= MAX_WORD}
        singles = {bytes([b]): words[i].encode() for i, b in enumerate(unused[:n_single]) if i < len(words)}
        self.words = singles | {bytes([b, k]): words[i].encode() for j, b in enumerate(unused[n_single:]) for k in range(256) if (i := n_single + 256 * j + k) < len(words)}
        kinds = [b"[" + b"".join(map(re.escape, singles)) + b"]"] if singles else []
        if leads := unused[n_single:]:
            kinds.append(b"[" + b"".join(re.escape(bytes([b])) for b in leads) + b"](?s:.)")
        self.token = re.compile(b"|".join(kinds)) if kinds else None

    def put(self, m: re.Match) -> bytes:
        run = m.group()
        if (found := self.tokens.get(run)) is not None:
            return found
        # a run that is too long with its blank is left whole
        return b" " + found if len(run) <= MAX_WORD and run[:1] == b" " and (found := self.tokens.get(run[1:])) is not None else run

    def encode(self, data: bytes) -> bytes:
        return RUNS.sub(self.put, data)

    def decode(self, data: bytes) -> bytes:
        return self.token.sub(lambda m: self.words[m.group()], data) if self.token else data


RUNS = re.compile(rb" ?[A-Za-z0-9]+")


def encode_blob(data: bytes, words: list[str], unused: list[int], n_single: int) -> bytes:
    """data with dictionary words replaced by tokens. Token values are bytes that data doesn't use."""
    return Codec(words, unused, n_single).encode(data)


def decode_blob(data: bytes, words: list[str], unused: list[int], n_single: int) -> bytes:
    return Codec(words, unused, n_single).decode(data)


@query()
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised with the corpus dictionary and read back: sizes and whether the bytes are the same."""
    letters = token_alphabet(spark, sf_dir).first()
    words = [r["word"] for r in dictionary_build(spark, sf_dir).orderBy("idx").collect()]  # at most 24 + 40 x 256
    unused = sorted(r["b"] for r in unused_bytes(spark, sf_dir).collect())[: letters["n_single"] + letters["n_lead"]]
    n_single = letters["n_single"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = Codec(words, unused, n_single)
        for batch in batches:
            data, offset = bytes_of(batch.column("data"))
            cells = [data[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:], strict=True)]
            coded = [codec.encode(c) for c in cells]
            same = [codec.decode(x) == c for x, c in zip(coded, cells, strict=True)]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offset), "coded_bytes": np.array([len(c) for c in coded], np.int64), "same": np.array(same, bool)}

    return over_batches(dealt(document_blobs(spark, sf_dir), "doc_id"), run, "doc_id long, n_bytes long, coded_bytes long, same boolean")
