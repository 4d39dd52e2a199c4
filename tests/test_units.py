"""Small fixtures: transforms, coders, files, streams, edge cases of blobs."""

import random

import numpy as np
from pyspark.sql import functions as F

from bytespan.functions.bytes import blocks, byte_array, lgamma2
from bytespan.operators import archive, codelength, coder, profile, transforms, vocabulary
from bytespan.sources import files
from bytespan.streaming import profiles


def blobs(spark, *cells):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cells)], "doc_id long, data binary")


def test_byte_array_of_all_bytes(spark):
    row = blobs(spark, bytes(range(256)), b"").select(byte_array("data").alias("b")).collect()
    assert row[0]["b"] == list(range(256)) and row[1]["b"] == []


def test_blocks_cover_every_byte(spark):
    rows = blocks(blobs(spark, b"", b"x", b"y" * 4096, b"z" * 4097)).collect()
    assert sorted((r["doc_id"], r["block"], r["n"]) for r in rows) == [(1, 0, 1), (2, 0, 4096), (3, 0, 4096), (3, 1, 1)]


def test_entropy_extremes(spark):
    out = {r["doc_id"]: r["e0"] for r in profile.block_entropies(blocks(blobs(spark, bytes(range(256)), b"\0" * 1000))).collect()}
    assert abs(out[0] - 8) < 1e-9 and out[1] == 0


def test_interleave_refuses_what_it_would_lose(spark):
    row = blobs(spark, b"abcde", b"ABCDABCD").select(transforms.interleave(byte_array("data"), 2).alias("m")).collect()
    assert row[0]["m"] is None and bytes(row[1]["m"]) == b"ACACBDBD"


def test_forward_only_transforms(spark):
    a = byte_array("data")
    row = blobs(spark, b"\x01\x80\xff").select(transforms.mask(a, 0x0F).alias("m"), transforms.repeat(a, 2).alias("r"), transforms.scale(a, 3, 2).alias("s"), transforms.mirror(a).alias("b")).first()
    assert row["m"] == [1, 0, 15] and len(row["r"]) == 6 and row["s"] == [1, 192, 255] and row["b"] == [255, 128, 1]


def test_code_length_equals_simulation(spark):
    data = b"the quick brown fox jumps over the lazy dog " * 4
    counts, bits, before = {}, 0.0, 0
    for b in data:
        c = counts.setdefault(before, [0] * 256)
        bits -= np.log2((c[b] + 1) / (sum(c) + 256))
        c[b] += 1
        before = b
    got = codelength.code_length(codelength.context_pairs(blobs(spark, data), 1), F.substring("key", 1, 1)).first()
    assert abs(got["bits"] - bits) < 1e-6 and got["n_bytes"] == len(data)


def test_lgamma(spark):
    from math import lgamma, log

    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3.5, 256, 1e6)], "x double").select("x", lgamma2(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - lgamma(r["x"]) / log(2)) < 1e-9 * max(1, abs(r["y"])) for r in rows)


def test_ans_and_mixing_round_trips():
    rng = random.Random(5)
    cells = [b"a" * 500, bytes(rng.randrange(256) for _ in range(700)), b"hello world! " * 30, b"x"]
    arrays = [np.frombuffer(c, np.uint8) for c in cells]
    tables = np.array([coder.frequency_table(a) for a in arrays])
    assert (tables.sum(1) == coder.SCALE).all()
    streams = coder.ans_encode(arrays, tables)
    assert coder.ans_decode(streams, [len(c) for c in cells], tables) == cells and len(streams[0]) < 20
    streams = coder.mix_encode(cells)
    assert coder.mix_decode(streams, [len(c) for c in cells]) == cells and len(streams[2]) < 120
    assert coder.mix_decode(coder.mix_encode([b"", b"ab"]), [0, 2]) == [b"", b"ab"]


def test_dictionary_round_trip():
    words, unused = [" the", "word", " of"], [200, 201, 202]
    data = b"the word of the words. of  the"
    coded = vocabulary.encode_blob(data, words, unused, 2)
    assert vocabulary.decode_blob(coded, words, unused, 2) == data and len(coded) < len(data)


def test_safe_paths(spark):
    names = ["/a/../b//./c", "..", "", "x\\y", "ok"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(files.safe_path("name").alias("s")).collect()
    assert [r["s"] for r in rows] == ["a/b/c", "file", "file", "x/y", "ok"]


def test_files_and_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"ABCD" + bytes([14, 3]) + (77).to_bytes(8, "little") + (123).to_bytes(4, "little"))
    (tmp_path / "sub" / "b.bin").write_bytes(b"xy")
    listed = {r["relative"]: r["size"] for r in files.listing(spark, str(tmp_path)).collect()}
    assert listed == {"a.bin": 18, "sub/b.bin": 2}
    assert files.total_size(spark, str(tmp_path)).first()["n_bytes"] == 20
    rows = {r["name"]: r["h"] for r in files.read_files(spark, str(tmp_path)).select("name", files.header("data").alias("h")).collect()}
    assert rows["b.bin"] is None and rows["a.bin"].asDict() == {"magic": "ABCD", "version": 14, "flags": 3, "original_bytes": 77, "crc32": 123}


def test_archive_written_and_selected(spark, tmp_path):
    members = spark.createDataFrame([("x", 1, "a", bytearray(b"AAAA")), ("x", 2, "b", bytearray(b"")), ("y", 3, "c", bytearray(b"\0\1"))], "archive string, doc_id long, name string, data binary")
    files.write_archive(archive.packed(members), f"{tmp_path}/archives")
    back = spark.read.parquet(f"{tmp_path}/archives").filter("archive = 'x'").first()
    assert bytes(back["payload"]) == b"AAAA" and back["n_members"] == 2
    files.write_report(archive.catalog(members), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 3


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = profiles.corpus_profile(profiles.stream_documents(spark, f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("profile").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("profile").collect())) == sorted(map(tuple, profiles.corpus_profile(table).collect()))


def test_keyed_average_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = profiles.keyed_average(stream).writeStream.outputMode("update").format("memory").queryName("averages").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["user_id"]: (r["n"], round(r["ema"], 6)) for r in spark.table("averages").collect()}
    from bytespan.plans import planner

    want = {r["user_id"]: (r["n"], r["ema"]) for r in planner.throughput_ema(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_headers_tell_what_is_wrong(spark):
    from bytespan.operators import formats

    good = b"BSPB\x0e\x00" + (5).to_bytes(8, "little") + b"\0" * 4 + (1).to_bytes(4, "little") + b"\0" + (2).to_bytes(4, "little") + b"xy"
    cells = [b"", good[:17], b"zzzz" + good[4:], good[:4] + b"\x07" + good[5:], good[:22], good[:-1], good, good[:5] + b"\x04" + good[6:20]]
    got = [r["s"] for r in blobs(spark, *cells).select("doc_id", formats.header_status("data").alias("s")).orderBy("doc_id").collect()]
    assert got == ["too short", "too short", "bad magic", "bad version", "truncated block table", "truncated stored data", "ok", "truncated dictionary header"]


def test_bit_fields_return_and_are_lowest_first():
    import pytest

    from bytespan.operators import formats

    assert formats.pack_bits(np.array([1, 0, 5, (1 << 56) - 3]), np.array([1, 2, 3, 56]))[:1] == bytes([1 | 5 << 3 | (1 << 6) & 0xC0])
    rng = random.Random(1)
    widths = np.array([rng.randint(0, 56) for _ in range(200)])
    values = np.array([rng.getrandbits(int(w)) if w else 0 for w in widths], np.uint64)
    packed = formats.pack_bits(values, widths)
    assert (formats.unpack_bits(packed, widths) == values).all() and len(packed) == -(-widths.sum() // 8)
    with pytest.raises(ValueError):
        formats.unpack_bits(packed, np.r_[widths, 56])


def test_xxh3_of_known_data(spark, tmp_path):
    from bytespan.operators import formats

    spark.createDataFrame([(1, ""), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["xxh3"] for r in formats.xxh3_docs(spark, str(tmp_path)).collect()} == {1: "2d06800538d394c2", 2: "e6c632b61e964e1f"}


def test_directory_shows_folders_first(spark, tmp_path):
    for name in ("b.TXT", "A.packed", "sub/x.txt", "Zed/deep/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = [(r["name"], r["is_dir"], r["is_archive"], r["size"]) for r in files.directory(spark, str(tmp_path)).collect()]
    assert got == [("sub", True, False, 0), ("Zed", True, False, 0), ("A.packed", False, True, 5), ("b.TXT", False, False, 5)]
    assert [r["name"] for r in files.listing(spark, str(tmp_path)).collect()] == ["A.packed", "b.TXT", "x.txt", "y.txt"]


def test_longest_matches_keep_the_longer():
    from bytespan.operators import contexts

    assert contexts.longest_matches(b"abcdefgh" * 3) == (12, sum(range(4, 16)), 15)
    # the last place after "1234" has four bytes in common, the last after the eight bytes before has nine
    data = b"xabcd1234Q" + b"zz1234R" + b"xabcd1234Q"
    assert contexts.longest_matches(data)[2] == 9 and contexts.longest_matches(b"") == (0, 0, 0)


def test_windows_of_blobs_larger_than_a_slice(spark, monkeypatch):
    from bytespan.functions import bytes as functions

    monkeypatch.setattr(functions, "SLICE", 7)
    data = bytes(range(50))
    rows = functions.windows(blobs(spark, data, b"", b"x"), 3).collect()
    padded = b"\0\0\0" + data
    assert {r["p"]: bytes(r["key"]) for r in rows if r["doc_id"] == 0} == {p: padded[p : p + 4] for p in range(50)}
    assert sum(r["doc_id"] == 2 for r in rows) == 1 and len(rows) == 51


def test_mutual_code_length_of_copies_and_strangers(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(97, 122, 4000, dtype=np.uint8).tobytes(), rng.integers(65, 90, 4000, dtype=np.uint8).tobytes()
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0)], "a long, b long")
    got = {r["b"]: r["distance"] for r in codelength.mutual_code_length(blobs(spark, a, a, b), pairs).collect()}
    assert abs(got[0]) < 1e-9 and got[1] < got[2] and got[2] > 0.9


def test_control_counts_waits_and_cancels(spark):
    import threading
    import time

    from bytespan.plans.control import Control

    control = Control(spark)
    assert control.counted(blobs(spark, b"abc", b"", b"12345")).count() == 3 and control.bytes_done() == 8
    control.pause()
    steps = []
    worker = threading.Thread(target=lambda: steps.append(control.proceed()))
    worker.start()
    time.sleep(0.2)
    assert control.is_paused() and not steps
    control.resume()
    worker.join(5)
    assert steps == [True]
    ended = []

    def job():
        control.begin("long")
        try:
            spark.range(1000, numPartitions=8).selectExpr("count(java_method('java.lang.Thread', 'sleep', 60L))").collect()
        except Exception as error:
            ended.append(error)

    worker = threading.Thread(target=job)
    worker.start()
    time.sleep(2)
    control.cancel()
    worker.join(20)
    assert control.is_cancelled() and not control.proceed() and not worker.is_alive()


def test_frames_return_and_tell_what_is_cut():
    data = b"hello world " * 60 + bytes(range(256))
    frame = coder.encode_framed(data, 300)
    assert coder.decode_framed(frame, len(data)) == data and len(frame) < len(data)
    assert coder.encode_framed(b"") == b"" and coder.decode_framed(b"", 0) == b""
    assert coder.decode_framed(frame[:-1], len(data)) is None and coder.decode_framed(frame, 5 * len(data)) is None and coder.decode_framed(b"x", 3) is None
    assert coder.decode_framed(coder.encode_framed(b"z"), 1) == b"z"


def test_states_and_refiners_learn():
    assert coder.NEXT_STATE[1, 0x00] == 0x01 and coder.NEXT_STATE[0, 0x0F] == 0x18 and coder.NEXT_STATE[1, 0xF3] == 0x84
    r = coder.Refiner(1, 2)
    before = r.refine(np.array([0.0]), np.array([1]))[0]
    for _ in range(200):
        r.refine(np.array([0.0]), np.array([1]))
        r.update(np.array([1]))
    assert abs(before - 0.5) < 1e-6 and r.refine(np.array([0.0]), np.array([1]))[0] > 0.9 and abs(r.refine(np.array([0.0]), np.array([0]))[0] - 0.5) < 1e-6
