"""The registered queries and the pipeline on the test tables."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, spark_rows, sql_rows
from conftest import TESTDATA
from test_llm_operators import bare, ordered, plain_components, plain_contamination
from tokenizers import Tokenizer

import corpus_pipeline
from nightdesk.llm import toxicity
from nightdesk.llm.queries import ORACLE, QUERIES

SF_DIR = f"{TESTDATA}/sf{os.environ.get('ORACLE_SF', '0.001')}"
LEARN_DIR = f"{TESTDATA}/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    names, expected = sql_rows(connect(SF_DIR), ORACLE[name])
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == names
    assert expected and spark_rows(df) == expected


def table(name, columns, sf_dir=SF_DIR):
    return connect(sf_dir).execute(f"SELECT {columns} FROM {name}").fetchall()


def test_op4(spark):
    labels = dict(table("labels", "doc_id, toxic", LEARN_DIR))
    rows = QUERIES["op4_toxicity"](spark, LEARN_DIR).collect()
    assert len(rows) == len(table("documents", "doc_id", LEARN_DIR))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op5(spark):
    lang = dict(table("documents", "doc_id, lang", LEARN_DIR))
    rows = QUERIES["op5_language"](spark, LEARN_DIR).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op9(spark):
    docs = sorted(table("documents", "doc_id, text"))
    got = [tuple(r)[:3] for r in QUERIES["op9_jaccard_join"](spark, SF_DIR).collect()]
    assert ordered(got) == ordered(plain_components(docs, 4, 85)[0])


def packed_ids(rows):
    return ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)


def plain_pieces(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    return ordered(out)


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 4096
    tokens = sum(r["length"] for r in rows)
    assert tokens > 4096 * (len(by) - 4) * 0.98


def test_op10(spark):
    rows = QUERIES["op10_packing"](spark, SF_DIR).collect()
    assert packed_ids(rows) == plain_pieces(table("documents", "doc_id, text"))
    check_sequences(rows)


def test_pipeline_stages_equal_plain_versions(spark):
    """Each stage is held against a plain version of itself on what the stage before it kept."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{LEARN_DIR}/documents.parquet")
    bench = table("benchmark", "item_id, text", LEARN_DIR)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, LEARN_DIR).cache()
        assert docs.columns == columns
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert len(set(after)) == len(after) and set(after) <= set(before)
        held[name] = (before, after)
    before, after = held["toxicity"]
    scored = toxicity.score(spark.read.parquet(f"{LEARN_DIR}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{LEARN_DIR}/documents.parquet"), spark.read.parquet(f"{LEARN_DIR}/labels.parquet")))
    assert {d for d, _ in after} == {r["doc_id"] for r in scored.collect() if r["nd_toxic_score"] < 0.5}
    before, after = held["exact_dedup"]
    best = {}
    for d, t in before:
        best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t or ""), d))
    assert {d for d, _ in after} == {d for _, d in best.values()}
    before, after = held["jaccard_join"]
    wanted = {c if n else d for d, n, c in plain_components(sorted(before), 5, 80)[0]}
    assert {d for d, _ in after} == wanted
    before, after = held["decontamination"]
    clean = {d for d, n, h, _ in plain_contamination(before, bench) if not (h > 0 and 20 * h >= n)}
    assert {d for d, _ in after} == clean
    rows = stages["packing"](spark, docs, LEARN_DIR).collect()
    assert packed_ids(rows) == plain_pieces(after)
    check_sequences(rows)
