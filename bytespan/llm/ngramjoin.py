"""N-gram Jaccard join by T-occurrence search: DivideSkip over inverted lists of word shingles.

A document's set holds its distinct shingles of k words. A partner of a set of n
shingles shares T >= ceil(t n) of them, so it is in one at least of the inverted
lists of any n - T + 1 shingles; the T - 1 others may stay long. The shingles
are ordered by rarity, and only the lists of each document's n - T + 1 rarest
are materialised (dealt out by shingle): they block the documents. Each query
then meets its candidates in chunks, and there DivideSkip decides: the lists of
the query's shingles over the chunk are divided into long and short ones, the
short are heap-merged, documents met T - L times or more go on, and the L long
lists are probed by binary search; documents that reach the overlap stay.

Rarity comes from a table of BUCKETS counters over all documents' shingles. Its
size is fixed (4 MB), so it may be gathered and broadcast at any scale; a
shingle's order is (its counter, its hash), the same for all documents.

Equal sets are one node from the start, so copies cost nothing. A list of f
nodes is first joined as a star around its smallest set, which is linear; the
links found there are contracted to components, and then only nodes that are
still in different components are compared. Lists of up to SMALL nodes give
their pairs. Longer open lists with the same leader form a cluster, whose texts
are sent to blocks of BLOCK against BLOCK nodes; a block keeps its components up to date,
compares only across them and returns only links that join two. Before any text
moves, parity signatures of 128 bytes (of which no more bits can differ than
shingles do) rule out pairs, and nodes of a block without a possible partner. So no group is
expanded into rows of pairs or gathered in one task, and as links inside a
component can't change it, the components are exact.

Defined cases: null or empty texts have no shingles, are linked with nothing and
form a component of their own; with fewer than k words the whole sequence is the
one shingle; rows that repeat a doc_id are one node each text, and a row's
component is the smallest doc_id that its text reaches; a row without a doc_id
takes no part and gets a null component; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytespan.llm.common import components, discard, fresh, salt_of, salted, saved, ship, small, tasks
from bytespan.llm.words import Words, distinct, mixed, parts

BUCKETS, CHUNK, SALTS = 1 << 20, 256, 16
#: Up to so many sets with copies or links are broadcast (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SETS = 500_000
ROW = 4096  # counters in one row of the table on its way
#: DivideSkip's constant: how much a binary probe costs against a step of the merge.
MU = 0.01
#: Long lists probed between two looks at which sets can still reach their overlap.
PROBED = 64
#: Lists of up to so many nodes give pairs; longer ones are compared block by block, BLOCK nodes against BLOCK.
SMALL, BLOCK = 8, 256
#: Bits of a set's parity signature. Where sets differ in few shingles no more than as many of these bits differ.
PARITY = 1024


def least_overlap(n: int | np.ndarray, num: int, den: int):
    """The fewest shared shingles of a set of n and any partner: ceil(num n / den)."""
    return -(-num * n // den)


class Lists:
    """Inverted lists over some sets: for each shingle the places of the sets that hold it, rising."""

    def __init__(self, sets: list[np.ndarray]):
        self.m, self.sizes = len(sets), np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(self.m), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.members = every[order], owner[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        self.shingles, self.begin = every[first], np.r_[first, len(every)]
        self.length = np.diff(self.begin)
        # one sorted array for binary probes of any list: its number times m, plus the member
        self.keys = np.repeat(np.arange(len(first)), self.length) * self.m + self.members

    def search(self, query: np.ndarray, num: int, den: int, active: np.ndarray | None = None) -> np.ndarray:
        """Places of the (active) sets whose Jaccard similarity with query is num / den or more, by DivideSkip."""
        nothing = np.empty(0, np.int64)
        if not len(query) or not len(self.shingles):
            return nothing
        need = -(-num * (len(query) + self.sizes) // (num + den))
        able = (self.sizes * den >= num * len(query)) & (len(query) * den >= num * self.sizes)
        found = np.flatnonzero(able if active is None else able & active)
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        lists = at[self.shingles[at] == query]
        if not len(found) or len(lists) < (t := int(need[found].min())):
            return nothing
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = max(int(self.length[lists[-1]]), 2)
        n_long = min(int(t / (MU * math.log2(longest) + 1)), t - 1)
        short, rest = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        counts = np.zeros(self.m, np.int64)
        for member, run in groupby(heapq.merge(*[self.members[self.begin[x] : self.begin[x + 1]].tolist() for x in short])):
            counts[member] = sum(1 for _ in run)
        found = found[counts[found] >= t - n_long]
        overlap = counts[found]
        for a in range(0, len(rest), PROBED):
            keep = overlap + (len(rest) - a) >= need[found]
            found, overlap = found[keep], overlap[keep]
            if not len(found):
                return nothing
            wanted = rest[None, a : a + PROBED] * self.m + found[:, None]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            overlap = overlap + (self.keys[place] == wanted).sum(1)
        return found[den * overlap >= num * (len(query) + self.sizes[found] - overlap)]


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch and their rows' shingle sets, as sorted unsigned hashes."""
    for part, raw, offsets in parts(batch, "text"):
        yield part, distinct(*Words(raw, offsets).shingles(k))


def rarity_table(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, shingle) pairs fall into each bucket, over all documents: BUCKETS saturating counters."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch, k):
                total += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        rows = total.reshape(-1, ROW)
        some = np.flatnonzero(rows.any(1))
        yield pa.record_batch({"row": pa.array(some, pa.int32()), "counts": pa.array([rows[i].astype("<i4").tobytes() for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[row] = total.get(row, 0) + np.frombuffer(raw, "<i4").astype(np.int64)
        yield pa.record_batch({"row": pa.array(list(total), pa.int32()), "counts": pa.array([np.minimum(x, 2**31 - 1).astype("<i4").tobytes() for x in total.values()], pa.binary())})

    schema = "row int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("row").mapInArrow(add, schema).collect()
    out = np.zeros(BUCKETS, np.int32)
    for r in rows:
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["counts"], "<i4")
    return out


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, s1, s2, prefix, parity): the size and hashes of each document's set, its n - T + 1 rarest shingles, and
    for each of PARITY classes of shingles whether their number is odd."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity_table(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part, sets in shingle_sets(batch, k):
                n = np.array([len(s) for s in sets], np.int64)
                s1 = np.array([mixed(s).sum() for s in sets], np.uint64)
                s2 = np.array([(mixed(s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)).sum() for s in sets], np.uint64)
                rare = [s[np.argsort(table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[: len(s) - least_overlap(len(s), num, den) + 1]] if len(s) else s for s in sets]
                odd = np.array([np.packbits((np.bincount((s >> np.uint64(44) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)) for s in sets])
                yield pa.record_batch({
                    "parity": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITY // 64), pa.int32()), pa.array(odd.view("<i8").ravel())),
                    "doc_id": part.column(0), "n": pa.array(n), "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)),
                    "prefix": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rare])], pa.int32()), pa.array(np.concatenate(rare).view(np.int64))),
                })

    return docs.mapInArrow(run, "parity array<long>, doc_id long, n long, s1 long, s2 long, prefix array<long>")


def shared_lists(nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, leader, leader_n): the short lists with two nodes or more; the leader is the smallest set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: it may be the first of a list, or alone in it
        for batch in batches:
            shingle, n, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "n", "node"))
            lead, lead_n, pending = None, None, False
            if held is not None:
                shingle, n, node = np.r_[held[0], shingle], np.r_[held[1], n], np.r_[held[2], node]
                lead, lead_n, pending = held[3], held[4], held[5]
            if not len(shingle):
                continue
            once = np.r_[True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]  # a repeated row is no second node
            shingle, n, node = shingle[once], n[once], node[once]
            first = np.r_[True, shingle[1:] != shingle[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            leader, leader_n = node[begin], n[begin]
            if lead is not None:
                own = begin == 0
                leader, leader_n = np.where(own, lead, leader), np.where(own, lead_n, leader_n)
            alone = first & np.r_[shingle[1:] != shingle[:-1], False]
            keep = ~alone
            if lead is not None and pending:
                keep[0] = True  # its list has rows before it
            held = (shingle[-1], n[-1], node[-1], leader[-1], leader_n[-1], bool(begin[-1] < len(first) - 1 or (lead is not None and begin[-1] == 0 and pending)))
            keep[-1] = False
            yield pa.record_batch({"shingle": shingle[keep], "node": node[keep], "n": n[keep], "leader": leader[keep], "leader_n": leader_n[keep]})
        if held is not None and held[5]:
            yield pa.record_batch({"shingle": np.array([held[0]]), "node": np.array([held[2]]), "n": np.array([held[1]]), "leader": np.array([held[3]]), "leader_n": np.array([held[4]])})

    postings = nodes.select("node", "n", F.explode("prefix").alias("shingle")).select("shingle", "n", "node")
    dealt = postings.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    return dealt.mapInArrow(run, "shingle long, node long, n long, leader long, leader_n long")


def crossing_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (q, c) of nodes that share a list, lie in different components and have sizes that allow a link.

    lists: (shingle, component, n, node). Each list is streamed in the order of its sizes; a node is paired with
    those before it that are not too small, in slices of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, node, comp = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "n", "node", "component")]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            q, c = [], []
            for a, b in zip(cut, np.r_[cut[1:], len(cols[0])], strict=True):
                if cols[0][a] != key:
                    key, n, node, comp = cols[0][a], n[:0], node[:0], comp[:0]
                old = len(n)
                n, node, comp = np.r_[n, cols[1][a:b]], np.r_[node, cols[2][a:b]], np.r_[comp, cols[3][a:b]]
                if len(n) < 2 or (comp == comp[0]).all():
                    continue
                for i in range(max(old, 1), len(n)):
                    j = int(np.searchsorted(n[:i], least_overlap(n[i], num, den)))
                    other = np.flatnonzero(comp[j:i] != comp[i]) + j
                    q.append(np.full(len(other), node[i]))
                    c.append(node[other])
                # sets too small for all that follow leave
                j = int(np.searchsorted(n, least_overlap(n[-1], num, den)))
                n, node, comp = n[j:], node[j:], comp[j:]
                if sum(map(len, q)) > 100_000:
                    yield pa.record_batch({"q": np.concatenate(q), "c": np.concatenate(c)})
                    q, c = [], []
            if q:
                yield pa.record_batch({"q": np.concatenate(q).astype(np.int64), "c": np.concatenate(c).astype(np.int64)})

    dealt = lists.select("shingle", "n", "node", "component").repartition(tasks(lists), "shingle").sortWithinPartitions("shingle", "n", "node")
    return dealt.mapInArrow(run, "q long, c long").select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c")).distinct()


def possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (q, c) whose signatures allow a link: before any text moves, a bound on how far sets differ."""
    a = marks.select(F.col("node").alias("q"), F.col("n").alias("qn"), F.col("parity").alias("qp"))
    b = marks.select(F.col("node").alias("c"), F.col("n").alias("cn"), F.col("parity").alias("cp"))
    both = pairs.join(a, "q").join(b, "c")
    apart = F.aggregate(F.zip_with("qp", "cp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    n = F.col("qn") + F.col("cn")
    need = F.floor((num * n + num + den - 1) / (num + den))
    return both.filter(apart <= n - 2 * need).select("q", "c").distinct()


def linked(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) out of (q, c) that are links, by DivideSkip of each q over its candidates in chunks.

    A query with many candidates is spread over SALTS groups, each with a copy of the query's text."""
    rows = pairs.select("q", "c", salt_of(SALTS, "c").alias("salt"))
    many = pairs.groupBy("q").count().filter(F.col("count") > CHUNK).select("q", F.lit(True).alias("many"))
    rows = rows.join(many, "q", "left").select("q", "c", F.when(F.col("many"), F.col("salt")).otherwise(F.lit(0)).alias("salt"))
    heads = rows.select("q", F.col("q").alias("c"), "salt").distinct()
    rows = rows.select("q", "c", "salt", F.lit(1).alias("part")).union(heads.select("q", "c", "salt", F.lit(0).alias("part")))
    rows = small(saved(rows)).join(texts.select(F.col("doc_id").alias("c"), "text"), "c")
    rows = rows.repartition(tasks(rows), "q", "salt").sortWithinPartitions("q", "salt", "part", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, ids, sets, out = None, [], [], [], []

        def decide() -> None:
            if sets:
                lists = Lists(sets)
                for query in queries:
                    out.extend((group[0], ids[i]) for i in lists.search(query, num, den).tolist())
            ids.clear()
            sets.clear()

        for batch in batches:
            for part, found in shingle_sets(batch, k):
                for q, salt, c, head, own in zip(*[part.column(x).to_pylist() for x in ("q", "salt", "c", "part")], found, strict=True):
                    if (q, salt) != group:
                        decide()
                        group, queries = (q, salt), []
                    if head == 0:
                        queries.append(own)
                    else:
                        ids.append(c)
                        sets.append(own)
                        if len(ids) >= CHUNK:
                            decide()
            if out:
                yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
                out = []
        decide()
        if out:
            yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def block_rows(clusters: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, i, j, own, node, component): the nodes of every pair of blocks that have a possible partner there in
    another component. Blocks are compared by signatures alone, 128 bytes a node."""
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = clusters.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    rows = small(saved(rows)).join(marks, "node").select("cluster", "i", "j", "own", "node", "component", "n", "parity")
    rows = rows.repartition(tasks(rows), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "node")

    def able(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][1], rows[0][2]
        own, component, n = (np.array([r[k] for r in rows]) for k in (3, 5, 6))
        bits = np.array([r[7] for r in rows], np.int64).view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        keep = np.zeros(len(rows), bool)
        for q in left:
            total = n[q] + n[right]
            fits = np.bitwise_count(bits[right] ^ bits[q]).sum(1) <= total - 2 * -(-num * total // (num + den))
            fits &= component[right] != component[q]
            keep[right[fits]] = True
            keep[q] |= fits.any()
        return [r[:6] for r, k in zip(rows, keep, strict=True) if k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def kept() -> pa.RecordBatch:
            out = able(held)
            return pa.record_batch({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(("cluster", "i", "j", "own", "node", "component"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))})

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("cluster", "i", "j", "own", "node", "component", "n", "parity")], strict=True):
                if held and row[:3] != held[0][:3]:
                    yield kept()
                    held = []
                held.append(row)
        if held:
            yield kept()

    return rows.mapInArrow(run, "cluster long, i int, j int, own int, node long, component long")


def block_links(clusters: DataFrame, marks: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join different components within clusters: (cluster, node, component)."""
    rows = small(saved(block_rows(clusters, marks, num, den))).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    rows = rows.repartition(tasks(rows), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "node")

    def compared(i: int, j: int, own: list[int], node: list[int], component: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        root, own_ = np.unique(component, return_inverse=True)[1], np.array(own)
        if i != j and not ((own_ == i).any() and (own_ == j).any()):
            return
        members = np.flatnonzero(own_ == j)
        lists = Lists([sets[x] for x in members])
        for q in np.flatnonzero(own_ == i):
            active = root[members] != root[q]
            if i == j:
                active &= members < q
            if not active.any():
                continue
            for x in members[lists.search(sets[q], num, den, active)]:
                if root[x] != root[q]:
                    yield node[q], node[x]
                    root[root == root[x]] = root[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        for batch in batches:
            for part, sets in shingle_sets(batch, k):
                for cluster, i, j, *row in zip(*[part.column(x).to_pylist() for x in ("cluster", "i", "j", "own", "node", "component")], sets, strict=True):
                    if (cluster, i, j) != group:
                        if group and (found := list(compared(*group[1:], *held))):
                            yield batch_of(found)
                        group, held = (cluster, i, j), ([], [], [], [])
                    for column, x in zip(held, row, strict=True):
                        column.append(x)
        if group and (found := list(compared(*group[1:], *held))):
            yield batch_of(found)

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: linked when den * intersection >= num * union."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = saved(signatures(docs, k, num, den))
    sig = saved(whole.select("doc_id", "n", "s1", "s2"))
    some = F.col("n") > 0, F.col("doc_id").isNotNull()
    members = saved(sig.filter(some[0] & some[1]).groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    # the prefixes stay where they are: each set is represented by the row of its smallest id
    nodes = whole.filter(some[0] & some[1]).join(small(members), ["s1", "s2"]).filter(F.col("doc_id") == F.col("node"))
    lists = saved(shared_lists(nodes))
    known = saved(lists.select("node").distinct())
    marks = saved(nodes.join(small(known), "node", "left_semi").select("node", "n", "parity").distinct())
    discard(whole)
    texts = docs.join(small(known).withColumnRenamed("node", "doc_id"), "doc_id")
    star = saved(lists.filter((F.col("node") != F.col("leader")) & (den * F.col("leader_n") >= num * F.col("n"))).select(F.col("leader").alias("q"), F.col("node").alias("c")).distinct())
    links = saved(linked(saved(possible(star, marks, num, den)), texts, k, num, den))
    discard()
    near = components(links)
    marked = lists.join(small(near), "node", "left").select("shingle", "n", "node", "leader", F.coalesce("component", "node").alias("component"))
    # sizes are partial aggregates, so that no long list is gathered to be counted
    open_ = marked.groupBy("shingle").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = saved(open_.filter(F.col("low") != F.col("high")).select("shingle", "size"))
    open_lists = saved(marked.join(small(open_), "shingle"))
    discard(open_)
    discard(lists)
    tried = star.select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c"))
    rest = crossing_pairs(open_lists.filter(F.col("size") <= SMALL), num, den).join(tried, ["q", "c"], "left_anti")
    more = saved(linked(saved(possible(rest, marks, num, den)), texts, k, num, den))
    big = open_lists.filter(F.col("size") > SMALL)
    # a list's nodes all meet under its leader; the lists of a group of near copies mostly have the same
    clusters = saved(big.select(F.col("leader").alias("cluster"), "node", "component").distinct())
    discard(open_lists, star)
    more = more.union(saved(block_links(clusters, marks, texts, k, num, den)))
    discard(clusters, marks, known)
    reach = components(links.union(more))
    # only sets that are linked or have copies can have another component than their row's own id
    reach = members.join(small(reach), "node", "left").filter((F.col("copies") > 1) | F.col("component").isNotNull())
    reach = saved(reach.select("s1", "s2", F.coalesce("component", "node").alias("component_id")))
    discard(members)
    (salt,) = fresh(sig, "_salt")
    if reach.count() <= BROADCAST_SETS:
        whole = sig.join(F.broadcast(reach), ["s1", "s2"], "left")
    else:  # a hot set's rows are spread over the salts
        whole = sig.withColumn(salt, salt_of(SALTS, "doc_id")).join(salted(reach, SALTS, salt), ["s1", "s2", salt], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; rows without a doc_id stay."""
    first, place = fresh(docs, "_first", "_place")
    kept = groups(docs, k, num, den).filter(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias(first)).distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(kept, F.col("`doc_id`") == F.col(first), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    out = out.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*cols)
    return out.union(docs.filter(F.col("`doc_id`").isNull()).select(*cols))
