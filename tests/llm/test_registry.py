"""Registered queries of the operators against their SQL, and the pipeline."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bytespan.llm import queries
from bytespan.llm.common import saved
from tests.llm.test_operators import brute_groups, brute_word_lines

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in cur.fetchall())


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_stages_work_on_all_that_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, "/root/testdata/sf0.001"))
        if name != "retrieval_packing":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, ""))
    assert docs.count() == 0


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def test_op2_replaces_what_was_planted(spark, tmp_path):
    """Entities made here, not found by the operator's own patterns: none is left, texts without any stay."""
    rng = np.random.default_rng(1)
    rows, planted = [], {}
    for i in range(60):
        mail, card, ip = f"u{rng.integers(10**9)}@host{i}.example.org", "4" + "".join(map(str, rng.integers(0, 10, 15))), f"10.{i}.7.{rng.integers(1, 250)}"
        phone, name = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", f"Mrs. Laura Qu{'abcdefghij'[i % 10]}rtz{'abcdefghij'[i // 10]}"
        planted[i] = [mail, card, ip, phone, name.split()[-1]]
        rows.append((i, f"write to {mail} or call {phone}, says {name}; host {ip}, card {card}.", "en", "s", 1))
    rows += [(100 + i, f"plain words without any entity at all in line {'abcdefghij'[i % 10]}", "en", "s", 1) for i in range(20)] + [(200, None, "en", "s", 1), (201, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r["text"] for r in queries.op2_pii_surrogates(spark, str(tmp_path)).collect()}
    assert all(v not in out[i] for i, values in planted.items() for v in values)
    assert all(out[i] == t for i, t, *_ in rows if i >= 100)
    assert len({out[i].split("write to ")[1].split(" or")[0] for i in planted}) == 60


def test_op3_equals_the_library(spark, small_docs):
    theirs = Tokenizer.from_file(queries.WORD_BPE)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_bpe_rounds(spark, SMALL).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in small_docs:
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))


def test_op5_equals_brute_force(spark, small_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_ngram_jaccard(spark, SMALL).collect()}
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in small_docs], 4, 85)


def test_op6_returns_every_page(spark):
    rows = queries.op6_main_text(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_op7_scores_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_factorisation_machine(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op10_loses_no_token(spark, small_docs):
    theirs = Tokenizer.from_file(queries.WORD_BPE)
    ids = {r["doc_id"]: [*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in small_docs}
    rows = queries.op10_retrieval_packing(spark, SMALL).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_pipeline_equals_its_stages_by_brute_force(spark, small_docs):
    """run() against: the rules' own verdicts, lines and groups by brute force, PII by the operator, and the library's tokens."""
    kept = {r["doc_id"] for r in queries.op9_adaptive_rules(spark, SMALL).filter("kept").collect()}
    texts = brute_word_lines([(r["doc_id"], r["text"]) for r in small_docs if r["doc_id"] in kept], 1)
    groups = brute_groups(list(texts.items()), 5, 80)
    left = [(d, t) for d, t in texts.items() if groups[d][1] == d]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in left], "doc_id long, text string, lang string, source string, n_chars long")
    theirs = Tokenizer.from_file(queries.WORD_BPE)
    want = {r["doc_id"]: len(theirs.encode(r["text"], add_special_tokens=False).ids) + 1 for r in corpus_pipeline.pii_surrogates(spark, docs, SMALL).collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want and sum(r["length"] for r in rows) == sum(want.values())


def test_library_stays_without_what_the_subpackage_needs():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()) > 0)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False", "True"] and int(out.stdout.split()[0]) > 80, out.stderr
