"""Context statistics: order-n tops, sparse, stride, indirect and case-folded contexts, words, runs, matches, lines."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytespan.functions.groups import Group, bytes_of, code_lengths, dealt, groups, over_batches, over_groups, run_starts, table_bytes, width
from bytespan.operators.codelength import LENGTH_SQL, POSITIONS_SQL, order1_predictions
from bytespan.registry import query
from bytespan.sources.blobs import DOCUMENT_BLOBS_SQL, document_blobs, table

#: Skip contexts by the places of the bytes before that they see, and strides (fixed values).
SPARSE = {"h1": (2,), "h0_h2": (1, 3), "h1_h2": (2, 3), "h0_h3": (1, 4), "h2_h3": (3, 4)}
STRIDES = (2, 3, 4, 8)


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, c AS (SELECT lag(b, 3, '00') OVER w || lag(b, 2, '00') OVER w || lag(b, 1, '00') OVER w AS context, b FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT context, count(*) AS n, count(DISTINCT b) AS n_next FROM c GROUP BY context) SELECT context, n, n_next FROM n ORDER BY n DESC, context LIMIT 100""")
def order3_context_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 commonest contexts of three bytes, and how many bytes follow each (a top-k report)."""
    pairs = key_counts(document_blobs(spark, sf_dir), 3).groupBy("key").agg(F.sum("c").alias("c"))
    context = F.lpad(F.hex(F.shiftright("key", 8)), 6, "0")
    by = pairs.groupBy(context.alias("context")).agg(F.sum("c").alias("n"), F.count("*").alias("n_next"))
    return by.orderBy(F.desc("n"), "context").limit(100)


#: Distinct keys that a task of key_counts() holds before it passes them on.
HELD = 1 << 20


def key_counts(blobs: DataFrame, order: int) -> DataFrame:
    """(key, c): how often each context of up to 6 bytes and the byte after it, as one number, occur; a key has a row for
    each task or HELD keys that counted it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, pending = [], 0
        for batch in batches:
            for _, g in groups(batch, "data"):
                key = g.context(order)[0] << np.uint64(8) | g.data
                key.sort()
                starts = run_starts(key)
                held.append((key[starts], np.diff(np.r_[starts, len(key)])))
                pending += len(starts)
                if pending > 2 * HELD:
                    held = [summed(held)]
                    pending = len(held[0][0])
                    if pending > HELD:
                        yield {"key": held[0][0].astype(np.int64), "c": held[0][1]}
                        held, pending = [], 0
        if held:
            key, c = summed(held)
            yield {"key": key.astype(np.int64), "c": c}

    return over_batches(dealt(blobs, "doc_id").filter(F.octet_length("data") > 0), run, "key long, c long")


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several tables as one."""
    key, c = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(key)
    starts = run_starts(key[order])
    return key[order][starts], np.add.reduceat(c[order], starts) if len(starts) else c


def picked(places: tuple[int, ...]):
    """The context of the bytes at these places before the coded one, of a group."""
    def context(g: Group) -> tuple[np.ndarray, int]:
        key = np.zeros(len(g.data), np.uint64)
        for p in places:
            key = key << np.uint64(8) | g.back(p)
        return key, 8 * len(places)

    return context


def view_lengths(blobs: DataFrame, views: dict) -> DataFrame:
    """Bits of all blobs under an adaptive model of each view, a function from a group to the contexts of its bytes. Blobs
    are dealt out by id and each view is one sort of a group's bytes, so only totals are shuffled."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        found = [code_lengths(g, *context(g)) for context in views.values()]
        return {"view": list(views), "n_bytes": [len(g.data)] * len(views), "n_contexts": [int(n.sum()) for _, n in found], "bits": [float(b.sum()) for b, _ in found]}

    totals = over_groups(dealt(blobs, "doc_id"), run, "view string, n_bytes long, n_contexts long, bits double")
    return totals.groupBy("view").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_contexts").alias("n_contexts"), F.round(F.sum("bits"), 2).alias("bits"))


def views_sql(views: dict[str, str]) -> str:
    cte = LENGTH_SQL[: LENGTH_SQL.index("SELECT doc_id, n_bytes, n_contexts, round")]
    lags = ", ".join(f"lag(b, {k}, '00') OVER w AS l{k}" for k in range(1, 17))
    parts = [f"SELECT * FROM (WITH pairs AS (SELECT doc_id, b, {e} AS ctx FROM lagged), {cte} SELECT '{n}' AS view, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_contexts) AS BIGINT) AS n_contexts, round(sum(bits), 2) AS bits FROM lengths)" for n, e in views.items()]
    return f"WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, lagged AS (SELECT doc_id, b, {lags} FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY p)) " + " UNION ALL ".join(parts)


NIBBLES_SQL = "l1[1] || l2[1]"


@query(views_sql({n: " || ".join(f"l{p}" for p in places) for n, places in SPARSE.items()} | {"high_nibbles": NIBBLES_SQL}))
def sparse_context_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits under contexts that skip bytes, and under the high halves of the last two."""
    high = lambda g: (g.back(1) >> np.uint64(4) << np.uint64(4) | g.back(2) >> np.uint64(4), 8)
    return view_lengths(document_blobs(spark, sf_dir), {n: picked(p) for n, p in SPARSE.items()} | {"high_nibbles": high})


@query(views_sql({f"stride_{s}": f"l{s} || l{2 * s}" for s in STRIDES}))
def stride_context_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits under the two earlier samples of the same lane."""
    return view_lengths(document_blobs(spark, sf_dir), {f"stride_{s}": picked((s, 2 * s)) for s in STRIDES})


FOLD_SQL = " || ".join(f"printf('%02X', ('0x' || l{k})::INT | 32)" for k in (3, 2, 1))


@query(views_sql({"casefold_order3": FOLD_SQL}))
def casefold_order3_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits under the last three bytes with their case bit set."""
    folded = lambda g: (picked((3, 2, 1))(g)[0] | np.uint64(0x202020), 24)
    return view_lengths(document_blobs(spark, sf_dir), {"casefold_order3": folded})


def indirect_sql(n: int) -> str:
    ctx = " || ".join(f"lag(b, {k}, '00') OVER w" for k in range(n, 0, -1))
    return f"SELECT {n} AS context_bytes, doc_id, b, p, {ctx} AS ctx FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY p)"


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, c AS ({" UNION ALL ".join(map(indirect_sql, (2, 3, 4)))}),
h AS (SELECT *, lag(b) OVER (PARTITION BY context_bytes, doc_id, ctx ORDER BY p) AS before FROM c)
SELECT context_bytes, doc_id, count(*) AS n, count(before) AS n_seen, count(*) FILTER (before = b) AS n_hits FROM h GROUP BY context_bytes, doc_id""")
def indirect_context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the byte that followed the same context last time follows it again, for contexts of 2, 3 and 4 bytes."""
    return indirect_hits(document_blobs(spark, sf_dir), (2, 3, 4))


def indirect_hits(blobs: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        seen, hits = [], []
        for n in orders:
            q = g.previous(*g.context(n))
            seen.append(g.sums((q >= 0).astype(np.int64)))
            hits.append(g.sums(((q >= 0) & (g.data[q] == g.data)).astype(np.int64)))
        return {"context_bytes": np.repeat(np.array(orders, np.int32), g.n), "doc_id": pa.chunked_array([rows.column("doc_id")] * len(orders)).combine_chunks(), "n": np.tile(g.size, len(orders)), "n_seen": np.concatenate(seen), "n_hits": np.concatenate(hits)}

    return over_groups(dealt(blobs, "doc_id"), run, "context_bytes int, doc_id long, n long, n_seen long, n_hits long")


#: ASCII letters in lower case, all other bytes as blanks.
LETTERS = bytes(b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Distinct grams that a task holds before it passes them on, and bytes of the table for each task that adds up.
GRAMS, GRAM_BYTES = 1 << 18, 1 << 22


def word_grams(docs: DataFrame, n: int) -> DataFrame:
    """(w1..wn, count) of consecutive runs of ASCII letters in lower case.

    Tasks count what they read, GRAMS at a time, so that a gram is shuffled once for many places; a gram is one string until
    it is counted. What adds up the counts is dealt over partitions in proportion to the table, so none outgrows memory."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            data, offset = bytes_of(batch.column("data"))
            for a, b in zip(offset[:-1], offset[1:], strict=True):
                words = data[a:b].tobytes().translate(LETTERS).split()
                counts.update(map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False)))
                if len(counts) > GRAMS:
                    yield table_of(counts)
                    counts = Counter()
        yield table_of(counts)

    table_of = lambda counts: {"gram": pa.array(counts.keys(), pa.binary()).cast(pa.string()), "c": pa.array(counts.values(), pa.int64())}
    texts = docs.filter(F.col("text").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_bytes(docs) // GRAM_BYTES)
    grams = over_batches(texts.select(F.encode("text", "UTF-8").alias("data")), run, "gram string, c long")
    grams = grams.repartition(parts, "gram").groupBy("gram").agg(F.sum("c").alias("n"))
    words = F.split("gram", " ")
    return grams.select(*[words[k].alias(f"w{k + 1}") for k in range(n)], "n")


def grams_sql(n: int) -> str:
    cols = ", ".join(f"w[i + {k}] AS w{k + 1}" for k in range(n))
    names = ", ".join(f"w{k + 1}" for k in range(n))
    return f"WITH l AS (SELECT list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM documents), g AS (SELECT {cols} FROM l, unnest(range(1, len(w) - {n - 2})) u(i)) SELECT {names}, count(*) AS n FROM g GROUP BY {names}"


@query(grams_sql(2))
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of word pairs."""
    return word_grams(table(spark, sf_dir, "documents"), 2)


@query(grams_sql(3))
def word_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of word triples."""
    return word_grams(table(spark, sf_dir, "documents"), 3)


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, f AS (SELECT doc_id, p, b, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY p) = b THEN 0 ELSE 1 END AS start FROM positions),
g AS (SELECT doc_id, b, sum(start) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f), r AS (SELECT doc_id, run, any_value(b) AS b, count(*) AS len FROM g GROUP BY doc_id, run)
SELECT len, b AS byte, count(*) AS n_runs, round(1 - exp(-0.1 * len), 6) AS weight FROM r GROUP BY len, b""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal bytes by length and byte, and the weight that a run model gives each length.

    Runs are matched inside each blob by one regular expression: no row per byte, no sort."""
    runs = document_blobs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.decode("data", "ISO-8859-1"), F.lit(r"(?s)((.)\2*)"), F.lit(1))).alias("run"))
    by = runs.groupBy(F.length("run").cast("long").alias("len"), F.substring("run", 1, 1).alias("c")).agg(F.count("*").alias("n_runs"))
    return by.select("len", F.hex(F.encode("c", "ISO-8859-1")).alias("byte"), "n_runs", F.round(1 - F.exp(-0.1 * F.col("len")), 6).alias("weight"))


#: The hash of four bytes, and its number of slots (fixed values).
HASH_PRIME, SLOTS = 2654435761, 1 << 20
#: How far back a match may lie, and the probability that its byte gets (fixed values); the others share the rest.
MATCH_WINDOW, MATCH_SURE = 1 << 23, 0.9
VALUES_SQL = "vals AS (SELECT doc_id, p, ('0x' || b)::BIGINT AS b FROM positions)"
SLOT_SQL = f"""slots AS (SELECT doc_id, p, b, CASE WHEN p >= 5 THEN ((xor(xor(xor(lag(b, 4) OVER w, lag(b, 3) OVER w << 3), lag(b, 2) OVER w << 7), lag(b, 1) OVER w << 13) * {HASH_PRIME}) & {SLOTS - 1}) END AS slot
  FROM vals WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
before AS (SELECT doc_id, p, b, slot, lag(b) OVER (PARTITION BY doc_id, slot ORDER BY p) AS guess, lag(p) OVER (PARTITION BY doc_id, slot ORDER BY p) AS q FROM slots WHERE slot IS NOT NULL),
guess AS (SELECT doc_id, p, b, slot, CASE WHEN p - q <= {MATCH_WINDOW} THEN guess END AS guess, CASE WHEN p - q <= {MATCH_WINDOW} THEN q END AS q FROM before)"""
MATCH_BITS = (-math.log2(MATCH_SURE + (1 - MATCH_SURE) / 255), -math.log2((1 - MATCH_SURE) / 255))


def match_guesses(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """(distance, right): for each byte how far back the last place with the same hash of four bytes is, 0 where there is
    none within MATCH_WINDOW or the byte is among the first four, and whether what followed there follows here. The slot is
    looked up before it is overwritten."""
    slot = g.back(4) ^ g.back(3) << np.uint64(3) ^ g.back(2) << np.uint64(7) ^ g.back(1) << np.uint64(13)
    q = g.previous(slot * np.uint64(HASH_PRIME) & np.uint64(SLOTS - 1), SLOTS.bit_length() - 1, g.place >= 4)
    distance = np.arange(len(q)) - q
    distance[(q < 0) | (distance > MATCH_WINDOW)] = 0
    return distance, (distance > 0) & (g.data[q] == g.data)


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, {VALUES_SQL}, {SLOT_SQL} SELECT doc_id, count(*) AS n, count(guess) AS n_guessed, count(*) FILTER (guess = b) AS n_hits,
round(8.0 * count(*) FILTER (guess IS NULL) + {MATCH_BITS[0]!r}::DOUBLE * count(*) FILTER (guess = b) + {MATCH_BITS[1]!r}::DOUBLE * count(*) FILTER (guess <> b), 3) AS bits FROM guess GROUP BY doc_id""")
def match_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the match model guesses and is right, and the bits that its probabilities cost."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        distance, right = match_guesses(g)
        return {"doc_id": rows.column("doc_id"), "n": g.size - 4, "n_guessed": g.sums((distance > 0).astype(np.int64)), "n_hits": g.sums(right.astype(np.int64))}

    blobs = dealt(document_blobs(spark, sf_dir), "doc_id").filter(F.octet_length("data") > 4)
    out = over_groups(blobs, run, "doc_id long, n long, n_guessed long, n_hits long")
    bits = 8.0 * (F.col("n") - F.col("n_guessed")) + MATCH_BITS[0] * F.col("n_hits") + MATCH_BITS[1] * (F.col("n_guessed") - F.col("n_hits"))
    return out.withColumn("bits", F.round(bits, 3))


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, {VALUES_SQL}, {SLOT_SQL} SELECT CAST(floor(log2(p - q)) AS INT) AS distance_class, count(*) AS n, count(*) FILTER (guess = b) AS n_hits FROM guess WHERE q IS NOT NULL GROUP BY 1""")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match candidates by the class of their distance, with hits."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        distance, right = match_guesses(g)
        at = np.flatnonzero(distance)
        kind = np.frexp(distance[at].astype(np.float64))[1] - 1
        n = np.bincount(kind)
        some = np.flatnonzero(n)
        return {"distance_class": some.astype(np.int32), "n": n[some], "n_hits": np.bincount(kind[right[at]], minlength=len(n))[some]}

    found = over_groups(dealt(document_blobs(spark, sf_dir), "doc_id"), run, "distance_class int, n long, n_hits long")
    return found.groupBy("distance_class").agg(F.sum("n").alias("n"), F.sum("n_hits").alias("n_hits"))


def match_confidence(length: Column, bit: Column) -> Column:
    """What a match of a length says, in the logistic domain, of a bit that its byte predicts: nothing without a match."""
    sure = F.least(400 + 58 * F.least(length, F.lit(28)), F.lit(2000))
    return F.when(length <= 0, 0).when(bit == 1, sure).otherwise(-sure)


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, f AS (SELECT doc_id, p, b, CASE WHEN lag(b) OVER (PARTITION BY doc_id ORDER BY p) = b THEN 0 ELSE 1 END AS start FROM positions),
g AS (SELECT doc_id, b, sum(start) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f), r AS (SELECT doc_id, run, any_value(b) AS b, count(*) - 1 AS len FROM g GROUP BY doc_id, run), t AS (SELECT len, ('0x' || b)::INT >> 7 AS bit, count(*) AS n FROM r GROUP BY ALL)
SELECT len AS length, bit, n, CASE WHEN len <= 0 THEN 0 WHEN bit = 1 THEN least(400 + 58 * least(len, 28), 2000) ELSE -least(400 + 58 * least(len, 28), 2000) END AS confidence FROM t""")
def match_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches at distance 1 (runs) by length and first predicted bit, with the signed confidence that they have there."""
    runs = document_blobs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.decode("data", "ISO-8859-1"), F.lit(r"(?s)((.)\2*)"), F.lit(1))).alias("run"))
    rows = runs.groupBy((F.length("run") - 1).cast("long").alias("length"), F.shiftright(F.ascii(F.substring("run", 1, 1)), 7).alias("bit")).agg(F.count("*").alias("n"))
    return rows.withColumn("confidence", match_confidence(F.col("length"), F.col("bit")).cast("long"))


def longest_matches(data: bytes) -> tuple[int, int, int]:
    """(places with a match, sum and maximum of verified lengths). A match is sought where none goes on: the last places
    after the same 8 and the same 4 bytes are both verified backwards, up to LONGEST bytes, and the longer one is kept."""
    n, total, most = matches_of(Group(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    return int(n[0]), int(total[0]), int(most[0])


#: How far back a match is verified.
LONGEST = 65535


def equal_bytes(text: bytes, words: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """How many bytes of text are equal from p and from q on in direction step, limit at most. words: at each place the next
    eight bytes in that direction, the nearest lowest. What goes beyond four words is few, and compared by itself."""
    out, live = np.zeros(len(p), np.int64), np.arange(len(p))
    for done in range(0, 32, 8):
        if not len(live):
            return out
        x = words[p[live] + step * done] ^ words[q[live] + step * done]
        more = (x == 0).astype(np.int64)
        for k in range(1, 8):
            more += x & np.uint64((1 << 8 * k) - 1) == 0
        out[live] = np.minimum(done + more, limit[live])
        live = live[(x == 0) & (out[live] < limit[live])]
    for i, a, b, most in zip(live.tolist(), p[live].tolist(), q[live].tolist(), limit[live].tolist(), strict=True):
        done, size, sure = 32, 64, 0  # sure: among so many bytes after done one is known to differ
        while done < most and sure != 1:
            size = sure // 2 if sure else min(size, most - done)
            if step > 0:
                same = text[a + done : a + done + size] == text[b + done : b + done + size]
            else:
                same = text[a - done - size : a - done] == text[b - done - size : b - done]
            done, sure = done + size * same, (sure - size if sure else 0) if same else size
            size *= 2
        out[i] = done
    return out


def matches_of(g: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """longest_matches() of every blob of a group.

    A match goes on while it is right, so what begins at a place decides where the next is sought. Candidates, their lengths
    and where each would end are found for all places at once; neighbours whose candidates are neighbours share one
    comparison. Then the search steps from match to match."""
    N, data = len(g.data), g.data.astype(np.uint64)
    if not N:
        return (np.zeros(g.n, np.int64),) * 3
    text, places = g.data.tobytes(), np.arange(N)
    end = np.repeat(g.offset[1:], g.size)
    padded = np.r_[np.zeros(8, np.uint64), data, np.zeros(8, np.uint64)]
    back, ahead = np.zeros(N + 1, np.uint64), np.zeros(N + 1, np.uint64)
    for k in range(8):
        back |= padded[7 - k : 8 - k + N] << np.uint64(8 * k)
        ahead |= padded[8 + k : 9 + k + N] << np.uint64(8 * k)
    four, bits = g.context(4)
    at, starts = g.by_place(four, bits, keep=g.place >= 4)
    own = np.zeros(N, np.uint64)  # the number of the four bytes before a place, 0 without
    own[at] = np.repeat(np.arange(1, len(starts) + 1, dtype=np.uint64), np.diff(np.r_[starts, len(at)]))
    q4 = np.full(N, -1)
    q4[at[1:]] = at[:-1]
    q4[at[starts]] = -1
    bits = width(len(starts) + 1)
    earlier = np.zeros(N, np.uint64)
    earlier[4:] = own[: max(N - 4, 0)]
    q8 = g.previous(earlier << np.uint64(bits) | own, 2 * bits, g.place >= 8)

    def verified(q: np.ndarray) -> np.ndarray:
        """Equal bytes before each place and its candidate, 0 without one."""
        live = q >= 0
        chained = live & np.r_[False, live[:-1] & (q[:-1] == q[1:] - 1)]
        first = np.flatnonzero(live & ~chained)
        size = equal_bytes(text, back, first, q[first], -1, np.minimum(g.place[q[first]], LONGEST))
        begun = np.zeros(N, np.int64)
        begun[first] = np.arange(1, len(first) + 1)
        of = np.maximum.accumulate(begun) - 1
        return np.where(live, np.minimum(size[of] + places - first[of], LONGEST), 0) if len(first) else np.zeros(N, np.int64)

    l8, l4 = verified(q8), verified(q4)
    q, length = np.where(l4 > l8, q4, q8), np.maximum(l4, l8)
    found = length > 0
    right = found & (g.data[q] == g.data)
    # a match goes on as its neighbour's does where their candidates are neighbours
    chained = right & np.r_[found[1:] & (q[1:] == q[:-1] + 1) & (places[1:] < end[:-1]), False]
    last = np.flatnonzero(right & ~chained)
    stop = np.where(chained, N, places)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    size = np.zeros(N, np.int64)
    size[last] = equal_bytes(text, ahead, last, q[last], 1, end[last] - last)
    follows = size[stop] + stop - places
    count = np.minimum(follows + 1, end - places)
    # from the end of a match to the next place that has one
    coming = np.minimum.accumulate(np.r_[np.where(found, places, N), N][::-1])[::-1]
    following, p, marks = coming[places + count].tolist(), int(coming[0]), []
    while p < N:
        marks.append(p)
        p = following[p]
    marks = np.array(marks, np.int64)
    c, n, of = count[marks], length[marks], g.blob[marks].astype(np.int64)
    most = np.zeros(g.n, np.int64)
    np.maximum.at(most, of, n + c - 1)
    whole = lambda x: np.bincount(of, x, g.n).astype(np.int64)
    return whole(c), whole(c * n + c * (c - 1) // 2), most


@query()
def match_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified match lengths of every document."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        n, total, most = matches_of(g)
        return {"doc_id": rows.column("doc_id"), "n_matched": n, "total_length": total, "longest": most}

    return over_groups(dealt(document_blobs(spark, sf_dir), "doc_id"), run, "doc_id long, n_matched long, total_length long, longest long", empty=True)


PART = 4096


@query(f"""WITH {DOCUMENT_BLOBS_SQL}, {POSITIONS_SQL}, w AS (SELECT doc_id, p, b, lag(b, 1, '00') OVER (PARTITION BY doc_id ORDER BY p) AS c FROM positions),
t AS (SELECT doc_id, p, -ln((count(*) OVER (PARTITION BY doc_id, c, b ORDER BY p) + 0.0) / (count(*) OVER (PARTITION BY doc_id, c ORDER BY p) + 255.0)) / ln(2) AS bits FROM w)
SELECT doc_id, (p - 1) // {PART} AS part, count(*) AS n, round(sum(bits), 3) AS bits FROM t GROUP BY doc_id, part""")
def rolling_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-1 bits of every part of PART bytes of each document, with all before it learnt.

    What order 1 gives each byte is known for all bytes of a group at once; parts add it up."""
    def run(rows: pa.RecordBatch, g: Group) -> dict:
        bits = -np.log2(order1_predictions(g))
        starts = np.flatnonzero(g.place % PART == 0)
        ids = rows.column("doc_id").take(pa.array(g.blob[starts].astype(np.int64)))
        return {"doc_id": ids, "part": g.place[starts] // PART, "n": np.diff(np.r_[starts, len(bits)]), "bits": np.add.reduceat(bits, starts)}

    out = over_groups(dealt(document_blobs(spark, sf_dir), "doc_id"), run, "doc_id long, part long, n long, bits double")
    return out.withColumn("bits", F.round("bits", 3))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT hex(encode(line)) AS h FROM l)
SELECT substr(h, 1, 8) AS head, length(h) // 2 AS width, count(*) AS n FROM b GROUP BY 1, 2""")
def line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their first four bytes and their width in bytes."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.encode("line", "UTF-8").alias("b"))
    return lines.groupBy(F.hex(F.substring("b", 1, 4)).alias("head"), F.octet_length("b").cast("long").alias("width")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT octet_length(encode(line)) AS width, count(*) AS n FROM l GROUP BY 1)
SELECT CAST(c AS BIGINT) AS "column", CAST(sum(n) AS BIGINT) AS n_bytes FROM w, unnest(range(1, width + 1)) u(c) GROUP BY 1""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes stand in each column of their line, from 1: lines are counted by width first, so a wide line is no
    row a byte."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    widths = lines.groupBy(F.octet_length(F.encode("line", "UTF-8")).cast("long").alias("width")).agg(F.count("*").alias("n")).filter("width > 0")
    return widths.select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("width"))).alias("column")).groupBy("column").agg(F.sum("n").alias("n_bytes"))
