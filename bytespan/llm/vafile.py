"""Exact top-k search by inner product with vector-approximation files.

Each component becomes floor(scale * x). Vectors are packed into blocks of at
most DATA_BLOCK rows, written once to shared storage as two files. The
approximation file has, per dimension, the least value and the width of
2**BITS equal cells, and of every vector the numbers of its cells, one byte a
component. The exact file has the integers, eight bytes a component.

A query's bounds for all vectors of a block are matrix products: with a vector
in cell c its component lies in [low + c w, low + c w + w - 1], so a score is at
least q.low + c.(q w) plus the sum of the negative q (w - 1), and at most that
plus the sum of the positive ones.

1. The approximation file alone is scanned for every block of queries; the kth
   largest lower bound over all blocks is the query's threshold. Tiles (a block
   of queries on a block of data) return k bounds a query, which are merged by
   query block, first in SALTS parts.
2. It is scanned once more against the thresholds. What reaches its query's
   threshold survives.
3. Only blocks with survivors are read from the exact file. Survivors' vectors
   are read in order of falling upper bound until the kth best exact score is
   above all bounds that are left; at most k rows a query and tile go on to the
   window that ranks them.

Queries are stated rows, packed into blocks of QUERY_BLOCK. They are broadcast
if they were measured to take at most BROADCAST_BYTES; else each block is sent
to every data block of its length by equi-joins, on (length, salt) and then on
the block's number, and no list of blocks or queries is gathered.

Defined cases: null vectors and vectors with null or non-finite components take
no part, nor do rows with a null id; only vectors of the same length are
compared; so do components that scale makes infinite; ties go to the smaller id;
rows that repeat an id are one candidate each, ask once (the least vector), and
a query meets every row but those of its own id; a query with fewer
than k candidates returns all; extra columns are ignored; an empty table gives
no rows. Sums beyond 53 bits are formed in Python integers and clipped to a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytespan.llm.common import salt_of, salted, saved, ship, tasks

BITS, DATA_BLOCK, QUERY_BLOCK, SALTS = 6, 2048, 1024, 16
#: Queries of at most so many bytes, counted first, are broadcast; beyond, they are joined.
BROADCAST_BYTES = 32_000_000
#: Scores whose bounds may exceed this are read exactly instead of bounded in 32-bit floats.
HUGE = 1e30
LONG = np.iinfo(np.int64)


def vectors(df: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """(id, v: array of doubles) of the vectors that take part."""
    good = F.forall(column, lambda x: F.coalesce(F.abs(scale * x.cast("double")) < float("inf"), F.lit(False)))
    part = F.col(key).isNotNull() & F.col(column).isNotNull() & F.coalesce(good, F.lit(False))
    return df.filter(part).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))


def packed(rows: Iterator[pd.DataFrame], scale: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length as blocks: (ids, floor(scale * components))."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int, ids: list, flat: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array(ids, np.int64), np.floor(scale * np.array(flat, float).reshape(len(ids), dim))

    for frame in rows:
        for i, v in zip(frame["id"].tolist(), frame["v"].tolist(), strict=True):
            ids, flat = held.setdefault(len(v), ([], []))
            ids.append(i)
            flat.append(v)
            if len(ids) == most:
                yield block(len(v), ids, flat)
                del held[len(v)]
    for dim, (ids, flat) in held.items():
        yield block(dim, ids, flat)


class Cells:
    """The approximation file of one block: per dimension the least value and the cells' width, and the cells."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cell: np.ndarray, bits: int = BITS):
        self.low, self.width, self.cell, self.cells = low, width, cell, 2**bits
        self._product: np.ndarray | None = None

    @classmethod
    def of(cls, data: np.ndarray, bits: int = BITS) -> Cells:
        n, dim = data.shape
        low, high = (data.min(0), data.max(0)) if n else (np.zeros(dim), np.zeros(dim))
        with np.errstate(over="ignore", invalid="ignore"):
            width = np.maximum(np.ceil((high - low + 1) / 2**bits), 1.0)
            cell = np.nan_to_num(np.floor((data - low) / width)).clip(0, 2**bits - 1)
        return cls(low, width, cell.astype(np.uint8), bits)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores, one row a query, by one scan of the cells."""
        if self._product is None:
            self._product = self.cell.T.astype(np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            step, spread = queries * self.width, queries * (self.width - 1)
            most = (np.abs(queries) * (np.abs(self.low) + self.cells * self.width)).sum(1)
            tame = most < HUGE
            base = np.where(tame, (queries * self.low).sum(1), 0)
            # rounding of 32-bit products and sums, and of the borders where they are beyond 53 bits
            slack = (len(self.low) + 4) * 2.0**-22 * np.where(tame, most, 0)
            middle = (np.where(tame[:, None], step, 0).astype(np.float32) @ self._product) + base[:, None].astype(np.float32)
            down = np.where(tame, np.minimum(spread, 0).sum(1) - slack, -np.inf)
            up = np.where(tame, np.maximum(spread, 0).sum(1) + slack, np.inf)
            return middle + down[:, None].astype(np.float32), middle + up[:, None].astype(np.float32)


class ApproximationFile:
    """Cells and exact vectors of one block."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bits: int = BITS):
        self.ids, self.data, self.bits = ids, data, bits

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every vector's score."""
        low, high = Cells.of(self.data, self.bits).bounds(q[None])
        return low[0], high[0]

    def exact(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        some = self.data[rows]
        if some.size == 0 or np.abs(some).max(initial=0) * np.abs(q).max(initial=0) * max(len(q), 1) < 2**53:
            return [int(x) for x in some @ q]
        whole = [int(x) for x in q]
        return [min(max(sum(int(x) * y for x, y in zip(r, whole, strict=True)), LONG.min), LONG.max) for r in some]

    def search(self, q: np.ndarray, k: int, rows: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best of some rows, given their upper bounds; ties to smaller ids."""
        order = np.argsort(-high, kind="stable")
        best: list[tuple[int, int]] = []
        step = 4 * k
        for begin in range(0, len(order), step):
            if len(best) >= k and best[k - 1][0] < -float(high[order[begin]]):
                break  # stored scores are negative: the kth is above every bound that is left
            these = rows[order[begin : begin + step]]
            best = sorted(best + [(-s, i) for s, i in zip(self.exact(these, q), self.ids[these].tolist(), strict=True)])[:k]
        return [(-s, i) for s, i in best]


def own_rows(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows that have their query's id."""
    order = np.argsort(ids, kind="stable")
    begin, end = (np.searchsorted(ids[order], asked, side) for side in ("left", "right"))
    n = end - begin
    q = np.repeat(np.arange(len(asked)), n)
    return q, order[np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(asked) else q


def tile_bounds(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower bounds, upper bounds, queries' ids, queries) of a tile; a query's own rows have the bound -inf."""
    q_ids = np.frombuffer(r.q_ids, np.int64)
    queries = np.frombuffer(r.q_data).reshape(len(q_ids), r.dim)
    cells = Cells(np.frombuffer(r.low), np.frombuffer(r.width), np.frombuffer(r.cell, np.uint8).reshape(r.n, r.dim))
    low, high = cells.bounds(queries)
    own = own_rows(np.frombuffer(r.ids, np.int64), q_ids)
    low[own] = high[own] = -np.inf
    return low, high, q_ids, queries


def best_bounds(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Pass 1: of every tile each query's k largest lower bounds."""
    for frame in frames:
        for r in frame.itertuples():
            low = tile_bounds(r)[0]
            if r.n > k:
                low = np.partition(low, r.n - k, axis=1)[:, r.n - k :]
            best = np.full((len(low), k), -np.inf, np.float32)
            best[:, : low.shape[1]] = low
            yield pd.DataFrame({"q_block": [r.q_block], "best": [best.tobytes()]})


def merged_bounds(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k largest of each query's bounds; rows come ordered by their block of queries."""
    held, best = None, None
    for frame in frames:
        for q_block, raw in zip(frame["q_block"].tolist(), frame["best"].tolist(), strict=True):
            own = np.frombuffer(raw, np.float32).reshape(-1, k)
            if q_block != held:
                if held is not None:
                    yield pd.DataFrame({"q_block": [held], "best": [best.tobytes()]})
                held, best = q_block, own
            else:
                best = np.partition(np.concatenate([best, own], 1), k, axis=1)[:, k:]
    if held is not None:
        yield pd.DataFrame({"q_block": [held], "best": [best.tobytes()]})


def survivors(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Pass 2: of every tile the rows whose upper bounds reach their queries' thresholds, by query."""
    for frame in frames:
        for r in frame.itertuples():
            _, high, q_ids, queries = tile_bounds(r)
            least = np.frombuffer(r.best, np.float32).reshape(-1, k).min(1)
            q, row = np.nonzero((high >= least[:, None]) & (high > -np.inf))
            if len(q):
                asked, at = np.unique(q, return_index=True)
                yield pd.DataFrame({
                    "block": [r.block], "q_ids": [q_ids[asked].tobytes()], "q_data": [queries[asked].tobytes()],
                    "begin": [np.r_[at, len(q)].astype(np.int64).tobytes()], "row": [row.astype(np.int32).tobytes()], "high": [high[q, row].tobytes()],
                })


def exact_best(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Survivors' exact scores, k a query and tile."""
    for frame in frames:
        for r in frame.itertuples():
            ids, q_ids, begin = (np.frombuffer(x, np.int64) for x in (r.ids, r.q_ids, r.begin))
            file = ApproximationFile(ids, np.frombuffer(r.data).reshape(len(ids), r.dim))
            queries, row, high = np.frombuffer(r.q_data).reshape(len(q_ids), r.dim), np.frombuffer(r.row, np.int32), np.frombuffer(r.high, np.float32)
            found = [(int(i), s, v) for i, q, a, b in zip(q_ids, queries, begin[:-1], begin[1:], strict=True) for s, v in file.search(q, k, row[a:b], high[a:b])]
            yield pd.DataFrame(found, columns=["query_id", "score", "vec_id"]).astype("int64")


def tiles(cells: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """Every block of cells with every block of queries of its length."""
    if small:
        return cells.join(F.broadcast(asked), "dim")
    numbers = cells.select("dim", "block", salt_of(SALTS, "block").alias("salt"))
    return cells.drop("dim").join(salted(asked, SALTS, "salt").join(numbers, ["dim", "salt"]).drop("salt"), "block")


def top_k(data: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer scores of every row that queries selects."""
    ship(data.sparkSession)

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, whole in packed(frames, scale, DATA_BLOCK):
            c = Cells.of(whole)
            yield pd.DataFrame({"dim": [whole.shape[1]], "n": [len(ids)], "ids": [ids.tobytes()], "low": [c.low.tobytes()], "width": [c.width.tobytes()], "cell": [c.cell.tobytes()], "data": [whole.tobytes()]})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, whole in packed(frames, scale, QUERY_BLOCK):
            yield pd.DataFrame({"dim": [whole.shape[1]], "q_ids": [ids.tobytes()], "q_data": [whole.tobytes()]})

    of = lambda f: lambda frames: f(frames, k)
    # Parquet keeps columns apart: scans of the cells never read the exact column
    blocks = saved(vectors(data, key, column, scale).mapInPandas(files, "dim int, n int, ids binary, low binary, width binary, cell binary, data binary").withColumn("block", F.monotonically_increasing_id()))
    cells, exact = blocks.drop("data"), blocks.select("block", "dim", "ids", "data")
    # a repeated id asks once
    once = vectors(data.filter(queries), key, column, scale).groupBy("id").agg(F.min("v").alias("v"))
    asked = saved(once.mapInPandas(ask, "dim int, q_ids binary, q_data binary").withColumn("q_block", F.monotonically_increasing_id()))
    small = (asked.agg(F.sum(F.length("q_data"))).first()[0] or 0) <= BROADCAST_BYTES
    found = tiles(cells, asked, small).select("block", "dim", "n", "ids", "low", "width", "cell", "q_block", "q_ids", "q_data").mapInPandas(of(best_bounds), "q_block long, best binary")
    parts = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = parts.repartition(tasks(data), "q_block", "salt").sortWithinPartitions("q_block").select("q_block", "best").mapInPandas(of(merged_bounds), "q_block long, best binary")
    least = parts.repartition("q_block").sortWithinPartitions("q_block").mapInPandas(of(merged_bounds), "q_block long, best binary")
    asked = saved(asked.join(least, "q_block"))
    left = tiles(cells, asked, small).select("block", "dim", "n", "ids", "low", "width", "cell", "q_ids", "q_data", "best")
    left = left.mapInPandas(of(survivors), "block long, q_ids binary, q_data binary, begin binary, row binary, high binary")
    ranked = left.join(exact, "block").select("dim", "ids", "data", "q_ids", "q_data", "begin", "row", "high").mapInPandas(of(exact_best), "query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
