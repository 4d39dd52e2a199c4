"""Queries over bytes: none makes a row of a byte, and the kernels equal brute force, in groups of any size."""

import random
import re
from math import lgamma, log, log2

import numpy as np
import pytest

from bytespan import queries
from bytespan.functions import groups
from bytespan.operators import codelength

SF = "/root/testdata/sf0.001"
rng = random.Random(3)
BLOBS = [b"x", b"abracadabra" * 30, bytes(rng.choices(range(256), k=700)), b"\0" * 300, "Ünï cödé, ".encode() * 40, bytes(rng.choices(b"ab ", k=999))]


def group(*blobs: bytes) -> groups.Group:
    return groups.Group(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def contexts(data: bytes, order: int) -> list[bytes]:
    padded = b"\0" * order + data
    return [padded[p : p + order] for p in range(len(data))]


def adaptive_bits(data: bytes, order: int) -> float:
    seen, total, bits = {}, {}, 0.0
    for c, b in zip(contexts(data, order), data, strict=True):
        bits -= log2((seen.get((c, b), 0) + 1) / (total.get(c, 0) + 256))
        seen[c, b], total[c] = seen.get((c, b), 0) + 1, total.get(c, 0) + 1
    return bits


@pytest.mark.parametrize("name", ["order1_code_length", "order2_code_length", "order4_code_length", "order5_code_length"])
def test_code_lengths_make_no_row_a_byte(spark, name):
    assert "Generate" not in plan(queries.QUERIES[name](spark, SF))


@pytest.mark.parametrize("order", [0, 1, 2, 4, 5, 6, 9, 16])
def test_code_lengths_of_any_order(order):
    g = group(*BLOBS)
    bits, n = groups.code_lengths(g, *g.context(order))
    assert np.allclose(bits, [adaptive_bits(b, order) for b in BLOBS], rtol=1e-9)
    assert n.tolist() == [len(set(contexts(b, order))) for b in BLOBS]


def test_groups_cut_batches_anywhere(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(BLOBS))), "data": BLOBS})
    want = [bytes(b) for b in BLOBS]
    for limit, most in ((1, 4096), (400, 4096), (1 << 20, 2), (1 << 20, 4096)):
        monkeypatch.setattr(groups, "GROUP", limit)
        monkeypatch.setattr(groups, "BLOBS", most)
        got = [(i, g.data[g.offset[k] : g.offset[k + 1]].tobytes()) for rows, g in groups.groups(batch.slice(1), "data") for k, i in enumerate(rows.column("doc_id").to_pylist())]
        assert got == list(enumerate(want))[1:]


def test_large_counts():
    n = np.array([0, 1, 255, 65535, 65536, 65537, 10**6, 2 * 10**9])
    assert np.allclose(groups.log2_factorial(n), [lgamma(x + 1) / log(2) for x in n], rtol=1e-13)


def test_places_of_equal_keys():
    g = group(*BLOBS)
    for order in (1, 3, 4):
        key, bits = g.context(order)
        seen, previous = g.seen(key, bits), g.previous(key, bits)
        at = 0
        for b in BLOBS:
            last, count = {}, {}
            for p, c in enumerate(contexts(b, order)):
                assert seen[at + p] == count.get(c, 0) and previous[at + p] == last.get(c, -1)
                count[c], last[c] = count.get(c, 0) + 1, at + p
            at += len(b)


def test_ablation_makes_no_row_a_byte_and_equals_simulation(spark):
    assert "Generate" not in plan(queries.QUERIES["ablation_order"](spark, SF))
    import pyarrow as pa

    g = group(*BLOBS)
    out = codelength.ablation(pa.RecordBatch.from_pydict({"doc_id": list(range(len(BLOBS)))}), g)
    assert np.allclose(out["l0"], [adaptive_bits(b, 0) for b in BLOBS]) and np.allclose(out["l1"], [adaptive_bits(b, 1) for b in BLOBS])
    assert out["n_bytes"].tolist() == [len(b) for b in BLOBS]


def test_mutual_lengths_make_no_row_a_byte_and_equal_simulation(spark):
    assert "Generate" not in plan(queries.QUERIES["mutual_lengths"](spark, SF))
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*BLOBS, b""])], "doc_id long, data binary")
    pairs = spark.createDataFrame([(1, 2), (4, 5), (5, 5), (0, 6), (0, 99)], "a long, b long")
    got = {(r["a"], r["b"]): r for r in codelength.mutual_code_length(rows, pairs).collect()}
    assert sorted(got) == [(1, 2), (4, 5), (5, 5)]  # pairs with an empty or missing blob are left out
    for (a, b), r in got.items():
        counts = {}
        for x in {a, b}:
            for c, y in zip(contexts(BLOBS[x], 2), BLOBS[x], strict=True):
                counts.setdefault(c, {}).setdefault(y, []).append(1)
        both = sum(lgamma(sum(map(len, by.values())) + 256) - lgamma(256) - sum(lgamma(len(n) + 1) for n in by.values()) for by in counts.values()) / log(2)
        assert abs(r["bits_both"] - both) < 1e-6 and abs(r["bits_a"] - adaptive_bits(BLOBS[a], 2)) < 1e-6 and abs(r["bits_b"] - adaptive_bits(BLOBS[b], 2)) < 1e-6


@pytest.mark.parametrize("name", ["sparse_context_code_length", "stride_context_code_length", "casefold_order3_code_length"])
def test_views_make_no_row_a_byte(spark, name):
    assert "Generate" not in plan(queries.QUERIES[name](spark, SF))


def test_indirect_hits_make_no_row_a_byte(spark):
    assert "Generate" not in plan(queries.QUERIES["indirect_context_hits"](spark, SF))


@pytest.mark.parametrize("name", ["match_hit_rate", "match_candidates"])
def test_match_guesses_make_no_row_a_byte(spark, name):
    assert "Generate" not in plan(queries.QUERIES[name](spark, SF))


def folded_matches(data: bytes) -> tuple[int, int, int]:
    """contexts.matches_of() by a fold over the bytes."""
    last: dict[bytes, int] = {}
    n = total = most = length = at = 0
    for p in range(4, len(data)):
        found = []
        for k in (8, 4):
            if p >= k:
                found.append(last.get(data[p - k : p]))
                last[data[p - k : p]] = p
        if length == 0:
            for place in dict.fromkeys(found):
                if place is not None:
                    own = 0
                    while own < contexts_of().LONGEST and place > own and data[place - own - 1] == data[p - own - 1]:
                        own += 1
                    if own > length:
                        at, length = place, own
        if length:
            n, total, most = n + 1, total + length, max(most, length)
            at, length = (at + 1, length + 1) if data[at] == data[p] else (at, 0)
    return n, total, most


def contexts_of():
    from bytespan.operators import contexts

    return contexts


@pytest.mark.parametrize("longest", [65535, 37])
def test_match_lengths_of_many_blobs_equal_the_fold(monkeypatch, longest):
    contexts = contexts_of()
    monkeypatch.setattr(contexts, "LONGEST", longest)
    base = bytes(rng.choices(range(256), k=2000))
    cells = [*BLOBS, b"", b"abcd", b"a" * 900, base + base[:1500] + b"x" + base[300:1700] + base]
    for k in (1, 2, 3, 6):
        for n in (5, 40, 300):
            x = bytes(rng.choices(b"abcdefgh"[:k], k=n))
            cells += [x, x + x[3:], x + b"#" + x]
    got = contexts.matches_of(group(*cells))
    assert [tuple(int(x[i]) for x in got) for i in range(len(cells))] == [folded_matches(c) for c in cells]


def test_match_lengths_keep_empty_documents(spark):
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["match_lengths"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rolling_costs_need_no_window_and_no_row_a_byte(spark):
    text = plan(queries.QUERIES["rolling_bpb"](spark, SF))
    assert "Generate" not in text and "Window" not in text


def test_key_counts_pass_on_what_they_hold(spark, monkeypatch):
    from bytespan.operators import contexts as module

    assert "Generate" not in plan(queries.QUERIES["order3_context_top"](spark, SF))
    monkeypatch.setattr(module, "HELD", 50)
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BLOBS)], "doc_id long, data binary").repartition(1)
    want = {}
    for b in BLOBS:
        for c, x in zip(contexts(b, 3), b, strict=True):
            want[int.from_bytes(c + bytes([x]), "big")] = want.get(int.from_bytes(c + bytes([x]), "big"), 0) + 1
    got = {r["key"]: r["n"] for r in module.key_counts(rows, 3).groupBy("key").sum("c").toDF("key", "n").collect()}
    assert got == want


@pytest.mark.parametrize("n", [2, 3])
def test_grams_are_counted_before_and_dealt_by_the_size_of_the_table(spark, monkeypatch, n):
    from bytespan.operators import contexts

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    name = ["word_bigrams", "word_trigrams"][n - 2]
    assert "Generate" not in plan(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(contexts, "GRAM_BYTES", 1 << 14)
    assert "hashpartitioning(gram#" in (text := plan(contexts.word_grams(docs, n))) and f", {groups.table_bytes(docs) >> 14}), REPARTITION_BY_NUM" in text
    monkeypatch.setattr(contexts, "GRAMS", 100)
    cells = [(1, "A b, c's a B\nc"), (2, None), (3, ""), (4, "one"), (5, "Éa bK b c " * 70)]
    got = {tuple(r)[:n]: r["n"] for r in contexts.word_grams(spark.createDataFrame(cells, "doc_id long, text string"), n).collect()}
    want = {}
    for _, t in cells:
        w = [x.lower() for x in re.findall("[A-Za-z]+", t or "")]
        for g in zip(*[w[k:] for k in range(n)], strict=False):
            want[g] = want.get(g, 0) + 1
    assert got == want


@pytest.mark.parametrize("name", ["archive_flags", "codec_plan", "block_classify", "stream_split", "delta_entropy", "best_transform", "transform_gains", "block_entropy"])
def test_blocks_are_counted_without_rows_of_bytes_or_joins(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "explode(concat" not in text and "explode(transform(filter" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_digests_are_of_bytes_not_of_arrays(spark):
    assert "array_join" not in plan(queries.QUERIES["transform_digests"](spark, SF)).split("MapInArrow")[0] and "MapInArrow" in plan(queries.QUERIES["transform_digests"](spark, SF))


def test_block_profile_equals_brute_force():
    from bytespan.operators import profile

    def entropy(values) -> float:
        counts = [list(values).count(v) for v in set(values)]
        return max(log2(sum(counts)) - sum(c * log2(c) for c in counts) / sum(counts), 0.0) if counts else 0.0

    noise = bytes(random.Random(1).choices(range(256), k=4096))
    cells = [*BLOBS, noise, bytes(x * 7 % 256 for x in range(4096)), b"\0\1" * 7]
    got = profile.block_profile(group(*cells))
    for i, b in enumerate(cells):
        gaps = lambda s: [(x - y) % 256 for x, y in zip(b[s:], b, strict=False)]
        e0 = entropy(b)
        want = {"n": len(b), "e0": e0, "e1": entropy(gaps(1)), "gain": len(b) * (e0 - entropy([b[0], *gaps(1)])), "least": min(entropy(gaps(s)) for s in (1, 2, 3, 4)) if e0 > profile.HIGH else np.inf}
        assert all(np.isclose(got[k][i], v, atol=1e-7) for k, v in want.items()), (i, {k: got[k][i] for k in want}, want)


def test_byte_values_are_counted_by_task(spark):
    from bytespan.operators import profile

    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*BLOBS, b""])] + [(99, None)], "doc_id long, data binary")
    counts = profile.byte_counts(rows)
    assert "Generate" not in plan(counts)
    want = np.bincount(np.frombuffer(b"".join(BLOBS), np.uint8))
    assert {r["b"]: r["n"] for r in counts.collect()} == {b: n for b, n in enumerate(want.tolist()) if n}


def test_a_dictionary_serves_many_blobs():
    from bytespan.operators import vocabulary

    words = ["one", " two", "three3", *sorted(f"w{i}" for i in range(700))]
    codec = vocabulary.Codec(words, [0, 93, 94, 92, 45], 2)
    for data in (b"", b"one two  two three3", " wörd w17 w699 one".encode(), b"x" * 41 + b" one" + b" " + b"w1" * 30):
        assert codec.decode(codec.encode(data)) == data
    assert codec.encode(b"one two one w0") == b"\0" + b"]" + b" \0 " + codec.tokens[b"w0"]
    assert vocabulary.Codec([], [], 0).decode(vocabulary.Codec([], [], 0).encode(b"one")) == b"one"


def test_coders_take_many_blocks_of_any_size(spark):
    from bytespan.operators import coder, profile

    assert "MapInArrow" in plan(queries.QUERIES["ans_roundtrip"](spark, SF))
    cells = [*BLOBS, b"", bytes(4096), bytes(range(256)) * 16]
    g = group(*cells)
    tables = coder.frequency_tables(profile.counted(g.data, g.blob, g.n))
    assert all(t.sum() == coder.SCALE for t, c in zip(tables, cells, strict=True) if c)
    chunks = [np.frombuffer(c, np.uint8) for c in cells]
    streams = coder.ans_encode(chunks, tables)
    assert coder.ans_decode(streams, [len(c) for c in cells], tables) == cells
    # a block's stream doesn't depend on its neighbours
    assert all(coder.ans_encode([c], tables[i : i + 1])[0] == streams[i] for i, c in enumerate(chunks))


def test_mixer_weights_in_lockstep_equal_the_recurrence(spark):
    from bytespan.operators import coder

    text = plan(queries.QUERIES["mixer_weights"](spark, SF))
    assert "MapInArrow" in text and "Exchange hashpartitioning(conv_id" in text
    cells = [b"", b"a", b"abcd", b"abcdabcdabcd" * 9, b"aab\0\0" * 30, *BLOBS]
    got = coder.mixer_weights_in(group(*cells))
    for i, data in enumerate(cells):
        w, run, place = np.full(7, 1 / 7), 0, {}
        seen = {}
        for t, x in enumerate(data):
            p = [1 / 256]
            for order in (1, 2, 4, 8):
                c = (b"\0" * order + data)[t : t + order]
                p.append((seen.get((order, c, x), 0) + 1) / (seen.get((order, c), 0) + 256))
                seen[order, c, x], seen[order, c] = seen.get((order, c, x), 0) + 1, seen.get((order, c), 0) + 1
            boost = (1 - np.exp(-0.1 * run)) * 0.99
            p.append(((boost if x == data[t - 1] else 0.0) + (1 - boost) / 255) if t else 1 / 256)
            run = run + 1 if t and x == data[t - 1] else 1
            q = place.get(data[t - 4 : t]) if t >= 4 else None
            p.append(1 / 256 if q is None else (0.9 if data[q] == x else 0.0) + 0.1 / 255)
            if t >= 4:
                place[data[t - 4 : t]] = t
            w = np.exp(w + 0.001 * np.log(p))
            w /= w.sum()
        assert np.allclose(got[i], w, rtol=1e-12)


def test_locksteps_hold_segments_of_like_length(monkeypatch):
    from bytespan.operators import coder

    monkeypatch.setattr(coder, "SEGMENTS", 4)
    size = np.array([9, 1, 2048, 3, 2048, 1, 2000, 2048, 2, 5])
    found = [size[x].tolist() for x in coder.locksteps(size)]
    assert found == [[2048, 2048, 2048, 2000], [9, 5, 3, 2], [1, 1]] and list(coder.locksteps(size[:0])) == []
    # flat tables: a segment's stream doesn't depend on its neighbours
    cells = [b"abcabcabc" * 5, b"", b"x", "Ünï cödé ".encode() * 6]
    assert coder.mix_encode(cells) == [coder.mix_encode([c])[0] for c in cells]
