"""Preference formatting and language-model scores on rough rows, against plain versions."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import ROUGH, SCHEMA, ordered, words

from nightdesk.llm import lm_score, preference

TURNS = [
    (0, 0, "system", "be <|im_end|> kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "good day"), (0, 3, "user", "bye"), (0, 4, "assistant", None),
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same é"), (3, 0, "user", "same"), (3, 1, "assistant", "same é"),
    (4, 0, "user", "alone"), (4, 1, "assistant", "x" * 100_000),
    (7, 5, None, "odd one"), (7, None, "assistant", "late"), (7, 5, "assistant", "tie"), (7, 5, "assistant", "tie"),
    (8, 0, "user", "a"), (9, 0, "user", "a"), (9, 1, "assistant", "b"),
    (None, 0, "user", "nobody"), (None, None, None, None),
]


def plain_pair(chosen, rejected):
    def turns(conv):
        held = sorted((t is None, t or 0, r or "user", (x or "").replace("<|im_", "<| im_")) for c, t, r, x in TURNS if c is not None and c == conv)
        return [h[2:] for h in held] or None

    def text(side):
        return "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in side)

    def spans(side):
        out, at = [], 0
        for r, x in side:
            head, size = len(f"<|im_start|>{r}\n"), len(x) + len("<|im_end|>\n")
            if r == "assistant":
                out.append((at + head, size))
            at += head + size
        return out

    a, b = turns(chosen), turns(rejected)
    n = 0
    while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    sides = [None if s is None else s[n:] for s in (a, b)]
    return (n, text((a or [])[:n]), *[None if s is None else text(s) for s in sides], *[None if s is None else spans(s) for s in sides])


def test_pairs_equal_plain_version(spark):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, prompt string").repartition(3)
    found = preference.preference_pairs(turns, preference.neighbours(turns)).collect()
    assert {(r["pair_id"], r["chosen_id"], r["rejected_id"]) for r in found} == {(0, 0, 1), (1, 2, 3), (2, 4, None), (3, None, 7), (4, 8, 9)}
    for r in found:
        got = tuple(None if v is None else [tuple(s) for s in v] if isinstance(v, list) else v for v in tuple(r)[3:])
        assert got == plain_pair(r["chosen_id"], r["rejected_id"])
        for side in ("chosen", "rejected"):
            for start, length in r[f"{side}_spans"] or []:
                assert r[side][start : start + length].endswith("<|im_end|>\n")
    none = turns.limit(0)
    assert preference.preference_pairs(none, preference.neighbours(none)).count() == 0


def plain_scores(rows, target, least):
    one, two, ctx, t_one, t_two, t_ctx = (Counter() for _ in range(6))
    for doc, text, *_ in rows:
        before = None
        for w in words(text):
            for every, mine, key in ((one, t_one, w), (two, t_two, (before, w)), (ctx, t_ctx, before)):
                every[key] += 1
                mine[key] += doc in target
            before = w
    total, t_total = sum(one.values()), sum(t_one.values())

    def loss(t, n, all_t, all_n):
        share = n / all_n
        return math.log(share) - math.log((t + lm_score.PRIOR * share) / (all_t + lm_score.PRIOR))

    blank = []
    for every, mine in ((one, t_one), (two, t_two)):
        n, t = (sum(c[k] for k in every if every[k] < least) for c in (every, mine))
        blank.append(loss(t, n, t_total, total) if n else 0.0)
    out = []
    for doc, text, *_ in rows:
        before, score, w = None, 0.0, words(text)
        for x in w:
            score += loss(t_one[x], one[x], t_total, total) if one[x] >= least else blank[0]
            score += loss(t_two[before, x], two[before, x], t_ctx[before], ctx[before]) if two[before, x] >= least else blank[1]
            before = x
        out.append((doc, len(w), round(score / 2 / len(w), 9) if w and t_total else 0.0))
    return out


@pytest.mark.parametrize(
    ("target", "merge", "carried"), [({1, 2, 6}, 1 << 22, 10**6), ({1, 2, 6}, 1 << 22, 0), ({8}, 50, 10**6), ({99}, 50, 0), (set(), 1 << 22, 10**6)]
)
def test_scores_equal_plain_version(spark, monkeypatch, target, merge, carried):
    monkeypatch.setattr(lm_score, "CARRIED", carried)
    monkeypatch.setattr(lm_score, "LEAST_COUNT", 3)
    monkeypatch.setattr(lm_score, "MERGE", merge)
    docs = spark.createDataFrame(ROUGH, SCHEMA).repartition(3, "n_chars")
    good = spark.createDataFrame([(t,) for t in target] + [(None,)], "doc_id long")
    got = [(r["doc_id"], r["words"], round(r["score"], 9)) for r in lm_score.score(docs, good).collect()]
    assert [g[:2] for g in ordered(got)] == [g[:2] for g in ordered(plain_scores(ROUGH, target, 3))]
    for a, b in zip(ordered(got), ordered(plain_scores(ROUGH, target, 3)), strict=True):
        assert a == pytest.approx(b, abs=1e-8)


def test_nothing_to_score(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm_score.score(none, none.select("doc_id")).count() == 0


def test_target_like_texts_score_lower(spark):
    rows = [(k, " ".join(f"{'good' if k % 4 == 0 else 'plain'}{j % 7}" for j in range(40))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = docs.where("doc_id % 8 = 0").select("doc_id")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, good).collect()}
    assert max(v for k, v in got.items() if k % 4 == 0) < 0 < min(v for k, v in got.items() if k % 4)


def test_every_target_document_counts(spark):
    """More of them than the 20,000 that were once counted, with repeated and null ids around them."""
    rows = [(k, f"good{k % 3} both" if k < 30_000 else f"plain{k % 3} both") for k in range(40_000)]
    rows += [(5, "good1 good1"), (None, "plain1 both"), (39_999, "both")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    good = spark.range(30_000).selectExpr("id AS doc_id").union(spark.createDataFrame([(None,), (7,), (70_000,)], "doc_id long"))
    flags = lm_score.flagged(docs, good.where("doc_id IS NOT NULL").selectExpr("doc_id AS good").distinct())
    assert {(r["target"], r["n"]) for r in flags.groupBy("target").agg(F.count("*").alias("n")).collect()} == {(1, 30_001), (0, 10_002)}
    got = [tuple(r) for r in lm_score.score(docs, good).collect()]
    want = plain_scores(rows, set(range(30_000)), lm_score.LEAST_COUNT)
    for a, b in zip(ordered(got), ordered(want), strict=True):
        assert a == pytest.approx(b, abs=1e-8)
