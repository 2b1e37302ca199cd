"""Ranked search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from nightdesk.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for number, (name, text) in enumerate(items):
        scored = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * count) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in Counter(terms(text)).items() if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(name, number, k, d[3], -d[0]) for k, d in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return out


def both(spark, docs, items, top=10):
    left = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, item long, score string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = ranked_search.search(left.repartition(3), right, top)
    rows = sorted(((r["item_id"], r["item"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=lambda x: (x[1], x[2]))
    want = plain_search(docs, items, top)
    return [(x[0], *x[2:]) for x in rows], [(x[0], *x[2:]) for x in want]


def corpus(rng, size):
    words = [f"t{int(rng.paretovariate(0.6)) % 500}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for k in range(size)]
    docs += [(size + k, docs[5][1]) for k in range(30)] + [(size + 50, " ".join(words)), (size + 60, None), (size + 61, ""), (size + 62, "-- !")]
    return docs + [(3, docs[3][1]), (None, docs[5][1]), (size + 70, "Ärger T1 t2\x00t3")], words


@pytest.mark.parametrize("seed,top", [(1, 10), (2, 3)])
def test_search_equals_plain_scores(spark, seed, top, monkeypatch):
    rng = random.Random(seed)
    docs, words = corpus(rng, 700)
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 200)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ranked_search, "FLOOR_SHARE", 3)
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    items += [("i1", "T7 t7, t8"), (None, "t1"), ("none", None), ("empty", ""), ("unknown", "zzz yyy"), ("ärger", "ärger ÄRGER")]
    got, want = both(spark, docs, items, top)
    assert got == want


def test_items_in_several_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs, words = corpus(rng, 100)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 30)
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(12))) for k in range(9)]
    got, want = both(spark, docs, items)
    assert got == want


def test_a_term_of_every_document_scores_nothing(spark):
    docs = [(k, "the") for k in range(2000)]
    got, want = both(spark, docs, [("a", "the")])
    assert got == want == []


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for left, right in ((docs, items), (one, items), (docs, spark.createDataFrame([("x", "a")], "item_id string, text string"))):
        assert ranked_search.search(left, right).collect() == []
