"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Texts are tokenised once and kept as ids. Document frequencies, their number and
mean length are the whole corpus's (a table of the vocabulary's size). Documents
are then ordered by the least hashes of their HEAVY heaviest shared terms, so
that those with the same rare terms come together from the whole corpus, and cut
into partitions by ranges of that order; ids and text hashes end it, so no term
or group of copies can make one partition large, and a retried task gives the
same result. A task streams its partition in shards of at most SHARD_DOCS
documents or SHARD_CHARS characters; each shard gets an inverted index over token
ids with BM25 weights. A seed (the document that a window begins with) queries
the index with all of its terms; its unused neighbours, best first, are taken
greedily until the
window is full. The one that no longer fits is cut there, and its rest begins
the next window as the next seed; so every window but the last of a partition
is full. Where no unused document shares a term, the next unused one follows.

Every id of every document, the closing id included, lies in exactly one piece.
Defined cases: a null or empty text is one closing id; a document longer than a
window is cut into several; equal scores go by order in the shard; repeated
rows are packed as often as they occur; languages are told apart by their terms
alone; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytespan.llm.bpe import broadcast_file, runs, vocabulary
from bytespan.llm.common import discard, saved, tasks
from bytespan.llm.words import buffers, mixed

SHARD_DOCS, SHARD_CHARS, HEAVY, KEYS = 512, 2_000_000, 8, 4
K1, B = 1.2, 0.75
KEY_SALTS = (np.arange(KEYS, dtype=np.uint64) << np.uint64(32))[:, None]


def kind_of(size: int) -> str:
    """The least kind of little-endian number that holds the ids of a vocabulary of so many."""
    return "<u2" if size <= 65536 else "<u4"


def terms_of(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a document and how often it has each."""
    ordered = np.sort(ids.astype(kind_of(size)), kind="stable")
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    return ordered[at], np.diff(np.r_[at, len(ordered)])


class Corpus:
    """What BM25 needs to know of the whole corpus: document frequencies, number of documents, mean length."""

    def __init__(self, df: np.ndarray, n: int, mean: float):
        self.df, self.n, self.mean = df, n, max(mean, 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def keys(self, ids: np.ndarray) -> list[int]:
        """The least of each of KEYS hashes over the heaviest terms that another document has too."""
        term, tf = terms_of(ids, len(self.df))
        shared = self.df[term] > 1
        term, tf = term[shared], tf[shared]
        if not len(term):
            return [-1] * KEYS
        heavy = term[np.argsort(-self.weights(term, tf.astype(float), len(ids)), kind="stable")[:HEAVY]].astype(np.uint64)
        return (mixed(heavy + KEY_SALTS) >> np.uint64(1)).min(1).tolist()


class Index:
    """BM25 over the documents of one shard: postings sorted by term. Weights are by the corpus; without one, the shard is it."""

    def __init__(self, docs: list[np.ndarray], size: int, corpus: Corpus | None = None):
        terms, counts, sizes = [], [], []
        for ids in docs:
            own, tf = terms_of(ids, size)
            terms.append(own)
            counts.append(tf)
            sizes.append(len(own))
        self.n = len(docs)
        length = np.array([len(d) for d in docs], float)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(float)
        doc = np.repeat(np.arange(self.n), sizes)
        df = np.bincount(term, minlength=size)
        weight = (corpus or Corpus(df, self.n, length.mean())).weights(term, tf, length[doc])
        self.begin_doc = np.r_[0, np.cumsum(sizes)]
        self.doc_terms, self.df = term, df
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.begin_term = np.r_[0, np.cumsum(df)]

    def query(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        a, b = self.begin_doc[seed], self.begin_doc[seed + 1]
        terms = self.doc_terms[a:b]
        terms = terms[self.df[terms] > 1]
        if not len(terms):
            return terms.astype(np.int64)
        at = runs(self.begin_term[terms], self.df[terms])
        total = np.bincount(self.post_doc[at], weights=self.post_weight[at], minlength=self.n)
        total[~unused] = 0
        found = np.flatnonzero(total)
        return found[np.argsort(-total[found], kind="stable")]


class Packer:
    """Fills windows across shards; pieces are (document's place, start, length, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.fill = window, first_sequence, 0

    def put(self, place: int, length: int, start: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
        """All ids of a document from start on, over as many windows as they need."""
        while start < length:
            n = min(length - start, self.window - self.fill)
            yield place, start, n, self.sequence, self.fill
            start, self.fill = start + n, self.fill + n
            if self.fill == self.window:
                self.sequence, self.fill = self.sequence + 1, 0

    def pack(self, docs: list[np.ndarray], size: int, corpus: Corpus | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """All pieces of a shard. The document that a window begins with is the seed of that window's neighbours."""
        index, unused, scan = Index(docs, size, corpus), np.ones(len(docs), bool), 0
        ranked: Iterator[int] = iter(())
        asked = -1
        while True:
            place = next((int(p) for p in ranked if unused[p]), None)
            if place is None:
                while scan < len(docs) and not unused[scan]:
                    scan += 1
                if scan == len(docs):
                    return
                place = scan
            unused[place] = False
            before = self.sequence
            yield from self.put(place, len(docs[place]))
            if self.sequence != before or asked != before:
                # the rest of this document, or this document whole, begins the open window
                asked, ranked = self.sequence, iter(index.query(place, unused))


def tokenised(docs: DataFrame, path: str, closing: int, size: int) -> tuple[DataFrame, Corpus]:
    """(doc_id, mark, chars, n, ids) of every row: ids as bytes of their kind, with the closing one; saved. And the
    statistics of all rows: each task adds a row with its document frequencies, size numbers, which come to the driver
    summed."""
    shared = broadcast_file(docs.sparkSession, path)
    kind, names = kind_of(size), ["doc_id", "mark", "chars", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, end = vocabulary(shared.value), np.array([closing], kind).tobytes()
        df, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for a, b, ids, begin in vocab.ids_of(*buffers(batch.column(3))):
                ids = ids.astype(kind)
                raw, at = ids.tobytes(), (begin * ids.itemsize).tolist()
                for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    df[terms_of(ids[x:y], size)[0]] += 1
                whole = [raw[x:y] + end for x, y in zip(at[:-1], at[1:], strict=True)]
                own = [batch.column(k).slice(a, b - a) for k in range(3)]
                yield pa.record_batch([*own, pa.array(np.diff(begin) + 1, pa.int64()), pa.array(whole, pa.binary())], names)
        df[closing] = rows
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([-1], pa.int64()), pa.array([df.tobytes()], pa.binary())], names)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, np.int64)
        for frame in frames:
            for raw in frame["ids"]:
                df += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    view = view.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.length("text").alias("chars"), "text")
    every = saved(view.mapInArrow(run, "doc_id long, mark long, chars int, n long, ids binary"))
    df = np.zeros(size, np.int64)
    for r in every.filter("n < 0").select("ids").mapInPandas(summed, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    whole = every.filter("n >= 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    return every, Corpus(df, whole["n"], whole["mean"] or 0.0)


def pack(docs: DataFrame, path: str, window: int = 2048, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids its ids
    as little-endian unsigned 32-bit bytes."""
    with open(path, encoding="utf-8") as f:
        size = max(vocabulary(f.read()).size, closing + 1)
    every, known = tokenised(docs, path, closing, size)
    corpus = docs.sparkSession.sparkContext.broadcast(known)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = np.array([corpus.value.keys(np.frombuffer(r, kind_of(size))) for r in frame["ids"]], np.int64).reshape(-1, KEYS)
            yield frame.assign(**{f"k{k}": keys[:, k] for k in range(KEYS)})

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[bytes]]]:
        keys, raws, chars = [], [], 0
        for frame in frames:
            for key, raw, own in zip(frame["doc_id"].tolist(), frame["ids"].tolist(), frame["chars"].tolist(), strict=True):
                if keys and (len(keys) >= SHARD_DOCS or chars >= SHARD_CHARS):
                    yield keys, raws
                    keys, raws, chars = [], [], 0
                keys.append(key)
                raws.append(raw)
                chars += own
        if keys:
            yield keys, raws

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for keys, raw in shards(frames):
            ids = [np.frombuffer(r, kind_of(size)) for r in raw]
            rows = list(packer.pack(ids, size, corpus.value))
            place, start, length, sequence, offset = map(np.array, zip(*rows, strict=True))
            cut = [ids[p][s : s + n].astype("<u4").tobytes() for p, s, n, _, _ in rows]
            out = pd.DataFrame({
                "doc_id": pd.Series([keys[p] for p in place], dtype="Int64"), "start": start, "length": length,
                "ids_crc32": [zlib.crc32(c) for c in cut], "doc_tokens": [len(ids[p]) for p in place],
                "sequence_id": sequence, "offset": offset,
            })
            yield out.assign(ids=cut) if with_ids else out

    kinds = "doc_id long, mark long, chars int, n long, ids binary, " + ", ".join(f"k{k} long" for k in range(KEYS))
    order = [*[f"k{k}" for k in range(KEYS)], "doc_id", "mark"]
    # saved, as ranges are found by a sample of the keys: that reads no ids and forms no key twice
    keys = saved(every.filter("n >= 0").mapInPandas(keyed, kinds))
    discard(every)
    near = keys.repartitionByRange(tasks(docs), *order).sortWithinPartitions(*order)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return near.select("doc_id", "ids", "chars").mapInPandas(run, schema)
