"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import connect
from conftest import TESTDATA
from hypothesis import given, settings
from hypothesis import strategies as st

from nightdesk.llm import periodic_runs
from nightdesk.llm.queries import QUERIES


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:], strict=False)))


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at >= max(6 - q, 3 * q) and smallest_period(words[at : end + q]) == q:
                out.append((at, end - at + q, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, words):
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    first = (len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    return (doc, *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_tiles(words):
    """The operator's steps without Spark."""
    ids, parts = periodic_runs.numbered(words), {}
    for octave, first, own, tile in periodic_runs.tiles(ids):
        size = periodic_runs.tile_size(octave)
        for q, low, high in periodic_runs.fragments(octave, tile, own - first, size, first == 0, first + len(tile) == len(ids)):
            parts.setdefault(q, []).append((first + low, first + high))
    out = []
    for q, spans in parts.items():
        for low, high in sorted(spans):
            if out and out[-1][2] == q and low <= out[-1][3]:
                out[-1][3] = max(out[-1][3], high)
            else:
                out.append([low, None, q, high])
    return sorted(((s, e - s + q, q) for s, _, q, e in out if e - s >= max(6 - q, 3 * q)), key=lambda r: (r[0], r[2]))


def texts(rng, count):
    for _ in range(count):
        words = []
        while len(words) < rng.choice((20, 100, 400)):
            root = [rng.choice((b"a", b"b", b"c", b"d")[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 30))]
            words += root * rng.randrange(1, 9) + root[: rng.randrange(len(root))]
        yield words


@pytest.mark.parametrize("tile,periods", [(1024, 16), (8, 4), (1, 1), (3, 2)])
def test_tiles_equal_plain_search(monkeypatch, tile, periods):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    monkeypatch.setattr(periodic_runs, "TILE_PERIODS", periods)
    for words in texts(random.Random(tile), 150):
        assert by_tiles(words) == plain_runs(words), words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"x", b"y"]), max_size=120))
def test_two_words(words):
    assert by_tiles(words) == plain_runs(words)


def test_long_text_of_one_word():
    words = [b"x"] * 30_000
    assert by_tiles(words) == [(0, 30_000, 1)]
    words = ([b"x"] * 500 + [b"y"]) * 40
    assert by_tiles(words)[:2] == [(0, 500, 1), (0, 20040, 501)]


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TILE", 16)
    monkeypatch.setattr(periodic_runs, "TILE_PERIODS", 2)
    docs = [(k, b" ".join(w).decode()) for k, w in enumerate(texts(random.Random(5), 40))]
    docs += [(100, None), (101, ""), (102, " \t\x0b"), (103, "a a a a a"), (104, "a a a a a a"), (105, "Ä Ä Ä Ä Ä Ä b A a A a A a A a A a")]
    docs += [docs[3], (None, docs[3][1]), (106, "no run here")]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, row int, words string, period long")
    got = periodic_runs.find_runs(df.repartition(3), texts=True).collect()
    rows = sorted((str(r["doc_id"]), r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"], r["collapsed_sha256"]) for r in got)
    want = []
    for doc, text in docs:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        want.append((str(doc), len(words), runs, kept.decode(), hashlib.sha256(kept).hexdigest()))
    assert rows == sorted(want)


def test_no_documents(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    sf_dir = f"{TESTDATA}/sf0.001"
    want = []
    for doc, text in connect(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(plain_row(doc, words) if n < 3000 else plain_long(doc, words))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in names) for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and any(r[1] for r in got)


def plain_long(doc, words):
    """As ``plain_row`` for long texts: the streaks of all periods by array comparison."""
    ids, out = np.unique(np.array(words), return_inverse=True)[1], []
    for q in range(1, len(ids) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(np.int8)))
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if high - low >= max(6 - q, 3 * q) and smallest_period(words[low : high + q]) == q:
                out.append((low, high - low + q, q))
    out.sort(key=lambda r: (r[0], r[2]))
    dropped = np.zeros(len(words), bool)
    for s, n, q in out:
        dropped[s + q : s + n] = True
    best = min(out, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (len(out), best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in out)
    kept = b" ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d)
    return (doc, *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
