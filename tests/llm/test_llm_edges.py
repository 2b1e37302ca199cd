"""Clashing columns, nulls, repeats and empty tables through whole operators and the pipeline's stages."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import TESTDATA
from test_llm_operators import ROUGH, SCHEMA, ordered
from tokenizers import Tokenizer

import corpus_pipeline
from nightdesk.llm import decontaminate, lm_score, packing, warc

SF_DIR = f"{TESTDATA}/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def clashing(spark):
    """The rough rows with columns named like those the operators use inside."""
    names = ["id", "key", "stay", "row", "target", "group", "length", "digest", "comp", "nd_id", "nd_key", "words", "payload"]
    rows = [(*r, *range(len(names))) for r in ROUGH]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_survive_rough_rows(spark, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    docs = clashing(spark).repartition(3)
    left = work(spark, docs, SF_DIR)
    assert left.columns == docs.columns
    kept, before = [tuple(r) for r in left.collect()], [tuple(r) for r in docs.collect()]
    assert kept and all(k in before for k in kept)
    assert work(spark, docs.limit(0), SF_DIR).collect() == []


def test_packing_stage_with_rough_rows(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, clashing(spark), SF_DIR).collect()
    got = ordered((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for doc, text, *_ in ROUGH:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((doc, at, len(part), zlib.crc32(part.tobytes())))
    assert got == ordered(want)
    assert packing.pack(clashing(spark).limit(0), WORD_BPE).collect() == []


def test_scores_with_clashing_columns(spark):
    plain = spark.createDataFrame(ROUGH, SCHEMA)
    good = spark.createDataFrame([(1, 5), (6, 5)], "doc_id long, target int")
    one, two = ([tuple(r) for r in lm_score.score(d, good).collect()] for d in (plain, clashing(spark)))
    assert ordered(one) == ordered(two) and len(one) == len(ROUGH)


def test_archives_with_clashing_columns(spark, tmp_path):
    page = "<p>" + "x" * 2000
    pages = [(1, "http://a/", page), (2, "http://b/", page), (3, None, None), (4, "u", "small"), (5, "u", "small")]
    rows = [(*p, "mine", b"other", 7, "no") for p in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest binary, bytes int, record_type string")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df, path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}


def test_longest_matches_with_repeated_and_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five"), (None, "six seven eight"), (2, None)], "doc_id long, text string")
    items = [("a", "one two three"), ("a", "one two three four"), (None, "six seven"), (None, "nothing here"), ("b", None), ("c", "")]
    got = {r["item_id"]: tuple(r)[1:] for r in decontaminate.longest_matches(docs, spark.createDataFrame(items, "item_id string, text string"), width=2).collect()}
    assert got == {"a": (0, 4, 1, 1), None: (0, 2, None, 0)}


def test_many_windows_are_searched_by_their_opening(spark):
    """Items that share words but no opening, and short items, with the plain search as measure."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choice(words, 60))) for k in range(40)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate(rng.integers(1, 12, 400).tolist())]
    items += [(1000 + k, " ".join(docs[k][1].split()[k : k + 9])) for k in range(20)]
    width = 5
    marked = decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width)
    windows = {}
    for item, text in items:
        w = text.split()
        for i in range(max(1, len(w) - width + 1)):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    for row in marked.collect():
        text, hit, found = dict(docs)[row["doc_id"]].split(), set(), set()
        for window, owners in windows.items():
            for i in range(len(text) - len(window) + 1):
                if tuple(text[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= owners
        assert {k for a, b in row["nd_spans"] for k in range(a, b)} == hit and set(row["nd_items"]) == found
