"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise term of rank RANK is formed by the sum-of-squares identity, so a
document costs time linear in its distinct words. Features are BUCKETS hashed
lower-cased words (their share of the document, scaled), statistics of the
text's bytes and words, and the n_chars column as metadata; lang, source and
doc_id are never looked at.

The model is fitted on the driver on at most SAMPLE labelled rows, those whose
id hashes lowest, as far as their features fit into SAMPLE_BYTES (documented
bounds; the fit is deterministic); scoring covers every whole text. Weights are of fixed size (BUCKETS x (RANK + 1) floats), so
they may be broadcast at any scale.

Defined cases: null texts count as empty and get a score; null n_chars counts as
0; a doc_id with several labels counts with its lowest; null labels and labels
without a document are left out; without any label, or with one kind only, the
score is the smoothed share of label 1; rows that repeat are scored alike, and of
those of one id one teaches; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytespan.llm.common import saved, ship
from bytespan.llm.words import Words, parts

BUCKETS, RANK, SAMPLE = 1 << 15, 8, 4000
#: Bytes of their features that come to the driver at most.
SAMPLE_BYTES = 128_000_000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.05, 1e-5, 7
#: Fewer rows are seen more often: so many in all at least.
SEEN = 40_000
#: Byte classes whose shares are statistics (fixed values).
CLASSES = (b"#*$%&|<>", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\n", b"@/\\=_+~^")
STATS = len(CLASSES) + 9
SIZE = BUCKETS + STATS


@dataclass
class Sparse:
    """Rows of a sparse matrix: row r has entries begin[r]..begin[r + 1] of (feature, value)."""

    feature: np.ndarray
    value: np.ndarray
    begin: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Sparse:
    """Features of some texts from their bytes."""
    words, n = Words(raw, offsets), len(offsets) - 1
    count = np.diff(words.begin)
    owner = np.repeat(np.arange(n), count)
    key, tf = np.unique(owner * BUCKETS + (words.hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    distinct = np.bincount(row, minlength=n)
    word_value = np.sqrt(tf / np.maximum(count[row], 1))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = np.full(256, len(CLASSES), np.int64)
    for i, c in enumerate(CLASSES):
        kind[list(c)] = i
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(of_byte * (len(CLASSES) + 1) + kind[raw], minlength=n * (len(CLASSES) + 1)).reshape(n, -1) / size[:, None]
    most = np.zeros(n)
    np.maximum.at(most, row, tf)
    few = np.maximum(count, 1)
    same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner[1:][same], minlength=n) / few
    stats = np.column_stack([
        np.sqrt(shares[:, : len(CLASSES)]), np.log1p(count) / 8, distinct / few, most / few, np.sqrt(stutter), size / few / 16,
        np.log1p(n_chars) / 10, np.abs(np.log1p(n_chars) - np.log1p(np.diff(offsets))), (count < 50), np.ones(n),
    ])
    feature = np.concatenate([bucket, np.tile(np.arange(BUCKETS, SIZE), n)])
    value = np.concatenate([word_value, stats.ravel()])
    rows = np.concatenate([row, np.repeat(np.arange(n), STATS)])
    order = np.argsort(rows, kind="stable")
    return Sparse(feature[order], value[order], np.r_[0, np.cumsum(np.bincount(rows, minlength=n))])


class Machine:
    """Weights, and the linear-time score."""

    def __init__(self, w0: float):
        self.w0, self.w = w0, np.zeros(SIZE)
        self.v = np.random.default_rng(SEED).normal(0, 0.02, (SIZE, RANK))

    def raw(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """(scores before the sigmoid, the sums of v x of each row)."""
        begin = x.begin[:-1]
        vx = self.v[x.feature] * x.value[:, None]
        total = np.add.reduceat(vx, begin, 0)
        squares = np.add.reduceat((vx * vx).sum(1), begin)
        return self.w0 + np.add.reduceat(self.w[x.feature] * x.value, begin) + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Adagrad over batches in a fixed random order."""
        rng = np.random.default_rng(SEED)
        g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
        for _ in range(max(EPOCHS, -(-SEEN // len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = [rows[i] for i in order[at : at + BATCH]]
                sizes = [len(f) for f, _ in own]
                x = Sparse(np.concatenate([f for f, _ in own]), np.concatenate([v for _, v in own]), np.r_[0, np.cumsum(sizes)])
                raw, total = self.raw(x)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[order[at : at + BATCH]]) / len(own)
                e = np.repeat(error, sizes) * x.value
                feature, back = np.unique(x.feature, return_inverse=True)
                dw = np.bincount(back, e, len(feature)) + DECAY * self.w[feature]
                dv = np.repeat(total, sizes, 0) * e[:, None] - self.v[x.feature] * (e * x.value)[:, None]
                dv = np.column_stack([np.bincount(back, dv[:, f], len(feature)) for f in range(RANK)]) + DECAY * self.v[feature]
                g0 += error.sum() ** 2
                gw[feature] += dw * dw
                gv[feature] += dv * dv
                self.w0 -= RATE * error.sum() / np.sqrt(g0)
                self.w[feature] -= 2 * RATE * dw / np.sqrt(gw[feature])
                self.v[feature] -= RATE * dv / np.sqrt(gv[feature])


def view(docs: DataFrame) -> DataFrame:
    chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in docs.columns else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.greatest(chars, F.lit(0)).alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most so many labelled documents. labels: (doc_id, label); choose its rows before."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    texts = view(docs).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat an id one teaches: each task sends no more than one of an id
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "n_chars"))
    texts = texts.withColumn("place", F.row_number().over(first)).filter("place = 1").select("doc_id", "text", "n_chars", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in parts(batch, "text"):
                x = features(raw, offsets, part.column(2).to_numpy(zero_copy_only=False))
                yield pa.record_batch({
                    "doc_id": part.column(0), "label": part.column(3),
                    "feature": pa.array([x.feature[a:b].astype("<i4").tobytes() for a, b in zip(x.begin, x.begin[1:])], pa.binary()),
                    "value": pa.array([x.value[a:b].astype("<f4").tobytes() for a, b in zip(x.begin, x.begin[1:])], pa.binary()),
                })

    # sample rows at most; of their sizes follows which of them fit into SAMPLE_BYTES, in the order of their ids' hashes
    found = saved(texts.mapInArrow(run, "doc_id long, label int, feature binary, value binary").withColumn("h", F.xxhash64("doc_id")))
    sizes = sorted((r["h"], r["b"]) for r in found.select("h", (F.octet_length("feature") + F.octet_length("value")).alias("b")).collect())
    fits = [h for (h, _), total in zip(sizes, np.cumsum([b for _, b in sizes]), strict=True) if total <= SAMPLE_BYTES]
    found = sorted(found.filter(F.col("h") <= fits[-1]).collect(), key=lambda r: (r["doc_id"], r["feature"], r["value"])) if fits else []
    y = np.array([r["label"] for r in found], float)
    share = (y.sum() + 1) / (len(y) + 2)
    machine = Machine(float(np.log(share / (1 - share))))
    if 0 < y.sum() < len(y):
        machine.fit([(np.frombuffer(r["feature"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in found], y)
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype("f4"), machine.v.astype("f4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = shared.value
        for batch in batches:
            for part, raw, offsets in parts(batch, "text"):
                x = features(raw, offsets, part.column(2).to_numpy(zero_copy_only=False))
                yield pa.record_batch({"doc_id": part.column(0), "score": pa.array(m.score(x).astype(float))})

    return view(docs).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt only from rows whose crc32 of the id isn't 0 modulo folds."""
    ship(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    machine = fit(docs, labels.filter(fold != 0), label)
    held_out = F.coalesce(fold == 0, F.lit(False))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
