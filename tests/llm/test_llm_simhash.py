"""SimHash groups against all pairs."""

import random

import pytest
import xxhash
from compare import connect
from conftest import TESTDATA

from nightdesk.llm import simhash
from nightdesk.llm.graph import components
from nightdesk.llm.queries import QUERIES
from nightdesk.llm.store import run_folder


def plain_print(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    size = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(docs, prints, radius=4):
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    smallest = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            smallest[root(k)] = min(smallest.get(root(k), d), d)
    return [(d, p, smallest.get(root(k))) for k, ((d, _), p) in enumerate(zip(docs, prints, strict=True))]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def found(df):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=key)


def cases():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A b\x0bC"), (None, "a b c"), (8, " ".join(base)), (8, " ".join(base))]
    for k in range(60):  # a family of near copies, each with a few changes of its own
        text = list(base)
        for _ in range(rng.randrange(1, 12)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((100 + k, " ".join(text)))
    docs += [(200 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for k in range(60)]
    docs.append((300, "x\x00y Ä b c d " * 50))
    return docs


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_groups_equal_all_pairs(spark, segments):
    docs = cases()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, fp int, comp string")
    want = plain_groups(docs, [plain_print(t) for _, t in docs])
    assert found(simhash.groups(df, segments=segments)) == sorted(want, key=key)


def test_links_between_groups_of_random_prints(spark):
    rng, nodes = random.Random(3), set()
    for _ in range(12):  # chains: steps of up to four bits, so groups are wider than the radius
        at = rng.getrandbits(64)
        for _ in range(30):
            nodes.add(at)
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                at ^= 1 << bit
    nodes = sorted(nodes)
    df = spark.createDataFrame([(n - (1 << 64) if n >> 63 else n, i % 4) for i, n in enumerate(nodes)], "fp long, comp long")
    sizes = df.groupBy("comp").count().withColumnRenamed("count", "size")
    got = {(r["a"], r["b"]) for r in simhash.ball_links(df.join(sizes, "comp"), 3, 4).collect()}
    want = {
        (min(i % 4, j % 4), max(i % 4, j % 4))
        for i, x in enumerate(nodes) for j, y in enumerate(nodes[:i]) if i % 4 != j % 4 and (x ^ y).bit_count() <= 4
    }
    assert got == want


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"W{k % 97}" for k in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SLICE_BYTES", 50)
    assert simhash.fingerprint(text.encode()) == whole == plain_print(text)


def test_no_documents(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    """A path with ascending numbers is done in a few rounds, and cycles and repeats change nothing."""
    links = [(k, k + 1) for k in range(300)] + [(5, 5), (400, 401), (401, 402), (402, 400), (400, 401)]
    folder = run_folder(spark, "components")
    got = dict(components(spark.createDataFrame(links, "a long, b long"), folder).collect())
    assert got == {k: 0 for k in range(301)} | {k: 400 for k in (400, 401, 402)}


def test_query(spark):
    sf_dir = f"{TESTDATA}/sf0.001"
    docs = connect(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()
    want = plain_groups(docs, [plain_print(t) for _, t in docs])
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op12_simhash"](spark, sf_dir).collect()]
    assert all(len(r["fingerprint"]) == 16 for r in QUERIES["op12_simhash"](spark, sf_dir).collect())
    assert sorted(got, key=key) == sorted(want, key=key)
