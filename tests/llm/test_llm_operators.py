"""Each operator on rough rows, against plain versions of itself."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightdesk.llm import decontaminate, exact_dedup, jaccard_join, language, packing, toxicity, url_rules, warc
from nightdesk.llm.rows import decided, text_key

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{k} étè{k}" for k in range(60))
NEAR = BASE.replace("word3 ", "other ")
ROUGH = [
    (1, "Same text here", "en", "a", 1, "k"),
    (2, "Same  text\there ", "en", "a", 2, None),
    (2, "Same  text\there ", "en", "a", 2, None),
    (None, "Same text here", None, None, None, "k"),
    (3, None, None, "b", None, None),
    (4, "", "en", "b", 0, "x"),
    (None, "", "en", "b", 0, "x"),
    (5, " \n\t ", "fr", None, 4, "x"),
    (6, BASE, "fr", "c", 5, "n"),
    (7, NEAR, "fr", "c", 5, "n"),
    (8, NEAR, "fr", "c", 5, "n"),
    (8, NEAR, "fr", "c", 5, "n"),
    (9, "12345 !!! 678", "de", "c", 5, "n"),
    (10, "Long " * 30_000 + BASE, "de", "c", 5, "n"),
    (11, "x" * 200_000, "de", "c", 5, "n"),
    (12, "tie one two three four five six seven eight nine ten eleven twelve", "en", "c", 5, "n"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nd_row string"


@pytest.fixture(scope="module")
def rough(spark):
    """Nulls, empties, white space, repeats, ties, long texts and a column with an internal name."""
    return spark.createDataFrame(ROUGH, SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- decontamination -----------------------------------------------------------------------------


def plain_contamination(docs, items, width=13):
    out = []
    for doc, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for name, item in items:
            i = words(item)
            size = min(width, len(i))
            wins = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if i else set()
            for at in range(len(w) - size + 1 if size else 0):
                if tuple(w[at : at + size]) in wins:
                    hit.update(range(at, at + size))
                    if name is not None:
                        found.add(str(name))
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return out


ITEMS = [
    (1, " ".join(BASE.split()[10:40])),
    (2, "same TEXT"),
    (20, "eleven"),
    (3, None),
    (4, ""),
    (None, "three four five"),
    (1, "nine ten"),
    (7, "Long " * 14),
]


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_contamination_equals_plain_search(spark, rough, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontaminate.mark(rough, bench, block_words=block_words)
    assert marked.columns[: len(rough.columns)] == rough.columns
    got = [(r["doc_id"], r["nd_words"], sum(s["end"] - s["start"] for s in r["nd_spans"]), tuple(r["nd_items"])) for r in marked.collect()]
    assert ordered(got) == ordered(plain_contamination(ROUGH, ITEMS))


def test_contaminated_documents_go_and_others_keep_their_columns(spark, rough, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.remove_contaminated(rough, bench)
    assert left.columns == rough.columns
    bad = [20 * h >= n and h > 0 for _, n, h, _ in plain_contamination(ROUGH, ITEMS)]
    assert ordered(map(tuple, left.collect())) == ordered(r for r, b in zip(ROUGH, bad, strict=True) if not b)
    assert decontaminate.remove_contaminated(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(rough, bench.limit(0)).count() == len(ROUGH)


def test_longest_matches(spark, rough):
    item = "unseen " + " ".join(BASE.split()[10:90]) + " unseen"
    bench = spark.createDataFrame([(1, item), (2, "no match at all"), (3, "eight nine")], "item_id long, text string")
    got = {r["item_id"]: tuple(r)[1:] for r in decontaminate.longest_matches(rough, bench).collect()}
    assert got == {"1": (1, 80, 6, 10), "3": (0, 2, 12, 8)}


def test_longest_matches_beyond_the_depth_of_the_array(spark):
    """Several places that reach the depth: the longest counts, at the first document that holds it."""
    w = [f"w{k}" for k in range(59)]
    docs = [(5, w[:40]), (4, w), (3, w), (6, w[:36] + ["zz"] + v) if (v := [f"v{k}" for k in range(59)][10:59]) else None, (7, ["zz"] + v[:-1]), (8, [f"v{k}" for k in range(36)])]
    docs = [(d, " ".join(x)) for d, x in docs]
    items = [(1, " ".join(w)), (2, " ".join(f"v{k}" for k in range(59))), (3, " ".join(w[2:20])), (4, "w1 w2")]
    got = {r["item_id"]: tuple(r)[1:] for r in decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for name, text in items:
        item, found = words(text), []
        for doc, body in docs:
            body = words(body)
            for at in range(len(item)):
                for pos in range(len(body)):
                    n = 0
                    while at + n < len(item) and pos + n < len(body) and item[at + n] == body[pos + n]:
                        n += 1
                    if n >= min(13, len(item)):
                        found.append((-n, doc, pos, at))
        n, doc, pos, at = min(found)
        want[str(name)] = (at, -n, doc, pos)
    assert got == want and got["1"] == (0, 59, 3, 0) and got["2"][:2] == (10, 49)


def test_windows_wider_than_the_array_is_deep(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w39", "zz"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(text.split()[:50]))], "item_id long, text string")
    got = {r["doc_id"]: r["nd_spans"] for r in decontaminate.mark(docs, bench, width=40).collect()}
    assert got[1] == [(0, 50)] and got[2] == []


# --- exact dedup ---------------------------------------------------------------------------------


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(spark, rough, empty):
    got = exact_dedup.exact_groups(rough).collect()
    assert len(got) == len(ROUGH)
    groups = {}
    for r in ROUGH:
        groups.setdefault(bare(r[1]), []).append(r)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = {}
    for r in got:
        mine = by[r["text_sha256"]]
        best = min(mine, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(mine))
        kept.setdefault(r["text_sha256"], []).extend([r["doc_id"]] * r["kept"])
    assert all(v == [min(by[k], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]] for k, v in kept.items())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_deduplicate_keeps_one_row_of_each_text(rough, empty):
    left = exact_dedup.deduplicate(rough)
    assert left.columns == rough.columns
    rows = [tuple(r) for r in left.collect()]
    assert all(r in ROUGH for r in rows)
    assert sorted(bare(r[1]) for r in rows) == sorted({bare(r[1]) for r in ROUGH})
    assert {r[0] for r in rows if bare(r[1]) == "Sametexthere"} == {2}
    assert exact_dedup.deduplicate(empty).count() == 0


def test_index_is_appended_and_survives_a_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "A"), (5, "c  ")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(one, path, "one").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(two, path, "two").collect()) == [4]
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(two, path, "two").collect()) == [4]
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(two, path, "two").collect()}
    assert got == {4: (4, True), 5: (3, False)}
    assert exact_dedup.DigestIndex(spark, path).entries().count() == 3


def test_a_batch_may_run_again_in_other_partitions(spark, tmp_path):
    """Equal rows under an equal name give equal results; other rows under it are refused."""
    rows = [(k % 6, "same  text" if k % 2 else "other text", k) for k in range(12)] + [(None, "same text", 0), (None, "same text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nd_id int")
    path, found = f"file://{tmp_path}/index", []
    for parts in (1, 5, 3):
        got = exact_dedup.exact_groups(docs.repartition(parts), path, "b").collect()
        found.append(ordered(tuple(r) for r in got))
        assert sum(r["kept"] for r in got) == 2
        left = exact_dedup.deduplicate(docs.repartition(parts), path, "b").collect()
        assert ordered((r["doc_id"], r["text"]) for r in left) == [(0, "other text"), (1, "same  text")]
    assert found[0] == found[1] == found[2]
    with pytest.raises(ValueError, match="other rows"):
        exact_dedup.exact_groups(docs.where("doc_id = 1"), path, "b")
    with pytest.raises(ValueError, match="needs a name"):
        exact_dedup.deduplicate(docs, path)
    assert exact_dedup.exact_groups(docs, path, "c").where("kept").count() == 0
    assert exact_dedup.DigestIndex(spark, path).entries().count() == 2


def test_two_indexes_do_not_meet(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for name in ("one", "two"):
        assert exact_dedup.deduplicate(docs, f"file://{tmp_path}/{name}", "b").count() == 1


def test_marked_rows_go_and_the_rest_stays(spark):
    rows = [(k, f"text {k % 7}", k) for k in range(50)] + [(3, "text 3", 99), (3, "text 3", 98), (None, "x", 1), (None, None, 2), (5, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nd_key int")
    ids = [(4, "text 4", 0), (3, "text 3", 1), (None, "x", 0), (5, "", 1), (77, "not there", 0)]
    marks = spark.createDataFrame(ids, "id long, text string, stay int").select("id", text_key().alias("key"), "stay")
    got = [tuple(r) for r in decided(docs, marks).collect()]
    want = [r for r in rows if r[:2] not in ((4, "text 4"), (3, "text 3"), (None, "x"))]
    assert ordered(r for r in got if r[0] != 3) == ordered(r for r in want)
    assert [r[:2] for r in got if r[0] == 3] == [(3, "text 3")] and all(r in rows for r in got)


def test_a_tokenizer_that_joins_across_white_space_is_refused():
    packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="across white space"):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


# --- Jaccard join --------------------------------------------------------------------------------


def plain_components(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    home = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = home[i], home[j]
                home = [min(a, b) if h in (a, b) else h for h in home]
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for x, h in zip(rows, home, strict=True) if h == home[i] and x[0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return out, home, sets


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_equal_all_pairs(rough, width, percent):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(rough, width, percent).collect()]
    assert ordered(got) == ordered(plain_components(ROUGH, width, percent)[0])


def test_components_of_a_family_that_drifts(spark, monkeypatch):
    """Links between far members only, and long lists with several centres."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 5)
    rng = np.random.default_rng(3)
    rows, text = [], [f"t{k}" for k in range(80)]
    for k in range(120):
        text = list(text)
        for at in rng.integers(0, len(text), 1 + k % 3):
            text[at] = f"n{rng.integers(0, 10_000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs).collect()]
    assert ordered(got) == ordered(plain_components(rows, 4, 85)[0])


def plain_links(rows, width, percent):
    sets = plain_components(rows, width, percent)[2]
    out = []
    for i, r in enumerate(rows):
        both = [len(sets[i] & s) for s in sets]
        out.append((r[0], sum(j != i and b > 0 and 100 * b >= percent * (len(sets[i]) + len(s) - b) for j, (b, s) in enumerate(zip(both, sets, strict=True)))))
    return out


@pytest.mark.parametrize("nodes", [256, 16])
def test_links_equal_all_pairs(spark, rough, monkeypatch, nodes):
    """Families whose members are linked to one another, with copies, in one block or several."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", nodes)
    rng = np.random.default_rng(5)
    rows = [(1000 + k, "five words are all here") for k in range(40)]
    for k in range(90):
        text = [f"f{k % 2}t{j}" for j in range(100)]
        for at in rng.integers(0, 100, k % 4):
            text[at] = f"n{rng.integers(0, 10_000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["links"]) for r in jaccard_join.groups(docs).collect()]
    assert ordered(got) == ordered(plain_links(rows, 4, 85)) and dict(got)[1000] == 39
    got = [(r["doc_id"], r["links"]) for r in jaccard_join.groups(rough).collect()]
    assert ordered(got) == ordered(plain_links(ROUGH, 4, 85))


def test_deduplicate_near_copies(rough, empty):
    left = jaccard_join.deduplicate(rough, width=5, percent=80)
    assert left.columns == rough.columns
    rows = [tuple(r) for r in left.collect()]
    _, home, sets = plain_components(ROUGH, 5, 80)
    assert len(rows) == len({h for h, s in zip(home, sets, strict=True) if s}) + sum(not s for s in sets)
    assert [r[0] for r in rows if r[1] in (BASE, NEAR)] == [6]
    assert jaccard_join.deduplicate(empty).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


def plain_segments(scores):
    """Maximal segments by their definition: the best segment, then the rest to its left and right."""
    best, span = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, span = total, (i, j + 1)
    if span is None:
        return []
    a, b = span
    right = [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]
    return plain_segments(scores[:a]) + [(a, b, best)] + right


def test_maximal_segments_equal_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-3, 3, rng.integers(0, 25)) + rng.random(1)[0] / 10
        got = toxicity.maximal_segments(scores)
        want = plain_segments(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxic_documents_are_found_and_go(spark, rough, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(600):
        w = [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefg"), 80), rng.integers(0, 90, 80), strict=True)]
        if k % 6 == 0:
            for at in rng.integers(0, 80, 4):
                w[at] = f"filthy{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    scored = toxicity.score(docs, model).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["nd_toxic_score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    bad = next(r for r in scored if r["doc_id"] == 6)
    assert any("filthy" in w for p in bad["nd_toxic_passages"] for w in bad["text"].split()[p["start"] : p["end"]])
    strange = toxicity.score(rough, model)
    assert strange.columns[: len(rough.columns)] == rough.columns
    assert all(0 <= r["nd_toxic_score"] <= 1 for r in strange.collect())
    assert toxicity.score(empty, model).count() == 0
    left = toxicity.remove_toxic(rough, marks)
    assert left.columns == rough.columns


@pytest.mark.parametrize("marks", [[], [(1, 0), (2, 0), (6, 0)], [(None, None)]])
def test_without_toxic_labels_everything_stays(spark, rough, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    assert toxicity.remove_toxic(rough, labels).count() == len(ROUGH)


# --- language ------------------------------------------------------------------------------------


def test_languages(spark, rough, empty):
    parts = {"xx": ["ka", "lo", "mu", "ri"], "yy": ["sté", "vö", "grü", "plä"]}
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("".join(rng.choice(parts[x], 3)) for _ in range(20)), x) for k in range(200) for x in ("xx", "yy")]
    docs = spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert set(model["languages"]) == {"xx", "yy"}
    got = language.predict(docs, model).collect()
    assert all(r["nd_lang"] == r["lang"] for r in got)
    strange = {r["text"]: r for r in language.predict(rough, model).collect()}
    for text in (None, "", " \n\t ", "12345 !!! 678"):
        assert (strange[text]["nd_lang"], strange[text]["nd_lang_score"]) == ("und", 0.0)
    assert all(r["nd_lang"] in ("xx", "yy") for t, r in strange.items() if t and re.search("[a-z]", t))
    assert language.predict(empty, model).count() == 0
    assert {r["nd_lang"] for r in language.predict(rough, language.fit(empty)).collect()} == {"und"}


def test_distant_texts_are_rejected(spark):
    rows = [(k, f"kalo murika lori mukalo {k}", "xx") for k in range(100)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "kalo murika lori mukalo"), (2, "zzyx qqwv zzyx")], "doc_id long, text string")
    assert {r["doc_id"]: r["nd_lang_rejected"] for r in language.predict(docs, model).collect()} == {1: False, 2: True}


# --- WARC ----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/", "x" * 1000),
    (5, "http://a/5", "x" * 1000),
    (3, None, "x" * 1000),
    (None, "http://n/", "x" * 1000),
    (5, "http://a/5", "x" * 1000),
    (7, "http://b/\r\nX: y", "short"),
    (8, "http://c/", "short"),
    (9, "http://d/", None),
    (10, "http://e/", "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (11, "http://f/", ""),
    (None, "http://g/", "y" * 2000),
    (None, "http://h/", "y" * 2000),
    (12, "http://i/", "z" * 3_000_000),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, compression=compression)
    found = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(found) == len(PAGES)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in found if r["record_type"] == "response")
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert {r["url"] for r in found if r["page_id"] == 7} == {"http://b/%0D%0AX: y"}
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        first = max(same, default=page) if len(raw) >= 1000 else page
        kind = "response" if page == first else "revisit"
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), kind, first if kind == "revisit" else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve(warc.read_archives(spark, path)).collect()]
    assert ordered(got) == ordered(want)


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0


def test_broken_archives_are_reported():
    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert [b for _, b in warc._parse(iter([whole, whole]))] == [b"abcde"] * 2
    for bad in (whole[:-3], whole[:20], b"HTTP" + whole):
        with pytest.raises(ValueError):
            list(warc._parse(iter([bad])))


# --- URL rules -----------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/es/1", "http://a.b.Example.ORG/es/", "https://example.org/en/12?x#y",
    "https://notexample.org/es/1", "ftp://x.com/fr/a", "ftp://x.com/de/a", "http://com/de/", "http://x.com?/de/", "http://x.com#/de/",
    "http://a..com/fr/", "http://.com/fr/", "x http://u.com/fr/", "http://example.org/es/1", "http://" + "a." * 5000 + "com/de/" + "p" * 50_000,
    "http://example.org/s", "http://sub.example.org/long/path/below", "http://example.org/long/pa", "http://example.org/line\n/x",
]
MORE = [("example.org", "/long/", "block"), ("example.org", "/long/path/", "allow"), ("sub.example.org", "/", "block"), ("org", "/", "block"), ("EXAMPLE.org", "/s", "block"), ("", "/", "block"), ("x.com", None, "block")]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in ((h.translate(LOWER), p, v) for h, p, v in rules if h and p is not None)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    top = max(fits, default=None)
    return host, path, top and top[2], top[3] if top else "allow"


@pytest.mark.parametrize("part_rows", [1_000_000, 2])
def test_rules_equal_plain_search(spark, monkeypatch, part_rows):
    monkeypatch.setattr(url_rules, "PART_ROWS", part_rows)
    rules = url_rules.RULES + MORE
    pages = spark.createDataFrame([(k % 20, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, nd_rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge(pages, table)
    assert sorted(got.columns) == sorted(["page_id", "url", "nd_host", "nd_path", "nd_rule", "nd_verdict"])
    rows = [(r["page_id"], r["nd_host"], r["nd_path"], r["nd_rule"], r["nd_verdict"]) for r in got.collect()]
    assert ordered(rows) == ordered((k % 20, *plain_verdict(u, rules)) for k, u in enumerate(URLS))
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["nd_verdict"] for r in url_rules.judge(pages, table.limit(0), "block").collect()} == {"block"}


# --- packing -------------------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_first_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 333):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], []
        for s in sizes.tolist():
            at = next((k for k, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= s
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


@pytest.mark.parametrize("sequence", [4096, 64])
def test_packed_pieces_hold_every_document(rough, sequence):
    tok = Tokenizer.from_file(TOKENIZER)
    packed = packing.pack(rough, TOKENIZER, sequence=sequence, with_ids=True)
    rows = packed.collect()
    docs = sorted(tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROUGH)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (len(ids), zlib.crc32(r["ids"])) == (r["length"], r["ids_crc32"])
        pieces.setdefault((r["doc_id"], r["start"], r["doc_tokens"]), []).append(ids)
    assert sum(r["length"] for r in rows) == sum(map(len, docs))
    for text in {r[1] for r in ROUGH}:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        for doc in {r[0] for r in ROUGH if r[1] == text}:
            for at in range(0, len(ids), sequence):
                assert ids[at : at + sequence] in pieces[(doc, at, len(ids))]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= sequence
    joined = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert joined == {k: sum(n for _, n in v) for k, v in by.items()}


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["a\x0bb\x0c.c", "<|endoftext|>x <|endoftext|> y", "é éx", "a\x1cb \x85c d　e", "It's'S ÀÉ, İx ǅ. ß! don't", "", "123 4,5.6"])
def test_words_give_the_ids_of_the_text(text):
    encoder = packing.WordEncoder(TOKENIZER)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == want
