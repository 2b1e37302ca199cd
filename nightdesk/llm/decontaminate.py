"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a run of whole documents) gets a suffix array over its words; every suffix of every
test item is binary-searched in it.  That yields, per item, the longest verbatim match with its
place, and per document the words covered by matches of a whole window.  Documents are then
reported or removed.  Matching is on words: A-Z lower-cased, runs of digits, letters and all
non-ASCII characters.

A window is ``width`` consecutive words of an item; an item with fewer words is one window.
A suffix can only match where all its words are known to the test set, so only those enter the
array.  The test set is worked off in blocks of bounded size, one pass over the documents each.

Null and empty texts have no words and are never contaminated.  Repeated documents are judged one
by one; item rows with the same id count as one item, and windows of an item without an id mark
words but name no item.  No documents give no rows; no items leave every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightdesk.llm.registry import query, table
from nightdesk.llm.rows import ROW, unwrapped, wrapped
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, mix, pieces, texts_of, word_table

WIDTH = 13
DEPTH = 32
#: Words by whose name a shard tells whether a window may occur in it.
OPENING = 3
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 2 << 20
SPANS, ITEMS, WORDS = "nd_spans", "nd_items", "nd_words"
MATCH_SCHEMA = "item_id string, item_pos long, length long, doc_id long, doc_pos long"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(word_table()).replace(b"\0", b" ").split()


class TestBlock:
    """The suffixes and windows of some test items, as word ids from 1 on."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        items = [(name, words) for name, words in items if words]
        self.width, self.names = width, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.items = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4") for _, words in items
        ]
        windows: dict[bytes, set[int]] = {}
        for k, ids in enumerate(self.items):
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1):
                windows.setdefault(ids[at : at + size].tobytes(), set()).add(k)
        self.windows = list(windows)
        self.owners = [sorted(x) for x in windows.values()]
        self.shortest = min((len(w) // 4 for w in self.windows), default=width)
        self.short_starts = np.unique([int.from_bytes(w[:4], "big") for w in self.windows if len(w) < 4 * width] or [0])
        self._keys: tuple | None = None

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowest and highest key of each window, the name of its first words, and which are too short for one; made once a task."""
        if self._keys is None:
            pad = [w[: 4 * DEPTH] for w in self.windows]
            low = np.array(pad, f"S{4 * DEPTH}")
            high = np.array([w.ljust(4 * DEPTH, b"\xff") for w in pad], f"S{4 * DEPTH}")
            first = np.zeros((len(pad), OPENING), ">u4")
            for k, w in enumerate(pad):
                head = np.frombuffer(w[: 4 * OPENING], ">u4")
                first[k, : len(head)] = head
            self._keys = low, high, opening(first), (first == 0).any(axis=1)
        return self._keys


def opening(heads: np.ndarray) -> np.ndarray:
    """A 64-bit name of the first ``OPENING`` words of each row."""
    name = np.zeros(len(heads), np.uint64)
    for k in range(OPENING):
        name = mix(name + heads[:, k].astype(np.uint64) + np.uint64(1))
    return name


class ShardSearch:
    """The suffix array of one shard and the searches in it."""

    def __init__(self, block: TestBlock, ids: np.ndarray):
        self.block, self.ids = block, ids
        known = ids > 0
        stop = np.where(known, len(ids), np.arange(len(ids)))
        run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(ids))
        start = run >= block.width
        if block.shortest < block.width:
            start |= (run >= block.shortest) & np.isin(ids, block.short_starts)
        at = np.flatnonzero(start)
        padded = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
        heads = np.empty((len(at), DEPTH), ">u4")
        live = np.ones(len(at), bool)
        for k in range(DEPTH):  # words after an unknown one play no part
            word = padded[at + k]
            live &= word > 0
            heads[:, k] = np.where(live, word, 0)
        keys = heads.view(f"S{4 * DEPTH}").ravel() if len(at) else np.zeros(0, f"S{4 * DEPTH}")
        order = np.argsort(keys, kind="stable")
        self.array, self.keys, self.heads = at[order], keys[order], heads[order]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and window number of every occurrence of a window, by two binary searches each.

        Only windows whose first words begin some suffix are searched, so a shard's cost follows what it shares with the block.
        """
        wins = self.block.windows
        if not wins or not len(self.array):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lowest, highest, first, short = self.block.keys()
        held = np.flatnonzero(short | np.isin(first, np.unique(opening(self.heads))))
        low = np.searchsorted(self.keys, lowest[held], "left")
        high = np.searchsorted(self.keys, highest[held], "right")
        count = high - low
        of = np.repeat(held, count)
        place = self.array[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        for at in range(DEPTH, self.block.width):  # wider windows than the array is deep
            same = np.array([int.from_bytes(wins[w][4 * at : 4 * at + 4] or b"\0", "big") for w in of.tolist()])
            fits = (same == 0) | (self.ids[np.minimum(place + at, len(self.ids) - 1)] == same)
            of, place = of[fits], place[fits]
        return place, of

    def longest(self) -> list[tuple[int, int, int, int]]:
        """Per item with a match in the array, every place of its longest: item, place there, length, place in the shard.

        A match holds a whole window, so only items with an occurrence are looked at.
        """
        out: list[tuple[int, int, int, int]] = []
        met = sorted({k for w in np.unique(self.occurrences()[1]).tolist() for k in self.block.owners[w]})
        for k in met:
            item = self.block.items[k]
            size = min(self.block.width, len(item))
            tails = np.zeros((len(item) - size + 1, DEPTH), ">u4")
            for at in range(len(tails)):
                tails[at, : len(item[at : at + DEPTH])] = item[at : at + DEPTH]
            keys = tails.view(f"S{4 * DEPTH}").ravel()
            found = np.searchsorted(self.keys, keys)
            common = np.zeros(len(tails), np.int64)
            for near in (np.minimum(found, len(self.array) - 1), np.maximum(found - 1, 0)):
                same = (self.heads[near] == tails) & (tails > 0)
                common = np.maximum(common, np.where(same.all(axis=1), DEPTH, np.argmin(same, axis=1)))
            most, places = size, []
            for at in np.flatnonzero(common == common.max()).tolist():
                for length, place in self._extended(item, at, tails[at, : common[at]].tobytes()):
                    if length >= most:
                        places = places if length == most else []
                        most = length
                        places.append((at, place))
            out += [(k, at, most, place) for at, place in places]
        return out

    def _extended(self, item: np.ndarray, at: int, head: bytes) -> list[tuple[int, int]]:
        """Length and place of the longest matches of the item from ``at`` on, which all begin with ``head``."""
        low = np.searchsorted(self.keys, np.array([head], f"S{4 * DEPTH}"), "left")[0]
        high = np.searchsorted(self.keys, np.array([head.ljust(4 * DEPTH, b"\xff")], f"S{4 * DEPTH}"), "right")[0]
        place, length = self.array[low:high], len(head) // 4
        if at:  # what goes on to the left is part of a longer match
            place = place[(place == 0) | (self.ids[place - 1] != item[at - 1])]
        while length >= DEPTH and at + length < len(item):
            on = place[self.ids[np.minimum(place + length, len(self.ids) - 1)] == item[at + length]]  # the last id is 0
            if not len(on):
                break
            place, length = on, length + 1
        return [(length, x) for x in place.tolist()]


def test_blocks(benchmark: DataFrame, width: int, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """The test items in blocks of about ``block_words`` words; the driver holds one at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = split_words((text or "").encode())
        held.append((name, words))
        size += len(words)
        if size >= block_words:
            yield TestBlock(held, width)
            held, size = [], 0
    if held:
        yield TestBlock(held, width)


def _shards(batches: Iterator[pa.RecordBatch], block: TestBlock) -> Iterator[tuple]:
    """Batch, words per document, first word of each document in the shard, and the shard's search."""
    get = block.vocabulary.get
    for whole in batches:
        for batch in pieces(whole, "text", SHARD_BYTES):
            sizes, ids = [], []
            for text in texts_of(batch.column("text")):
                words = split_words(text)
                sizes.append(len(words))
                ids.extend([get(w, 0) for w in words])
                ids.append(0)  # no match runs into the next document
            sizes = np.array(sizes, np.int64)
            yield batch, sizes, np.cumsum(sizes + 1) - (sizes + 1), ShardSearch(block, np.array(ids, np.uint32))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` of all documents (default: all) with what was found in each.

    ``nd_words`` counts the words, ``nd_spans`` lists the covered stretches of words (start, end),
    ``nd_items`` the ids of the items found; columns of these names are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (WORDS, SPANS, ITEMS)] if keep is None else keep
    found = T.StructType([
        T.StructField(WORDS, T.LongType()),
        T.StructField(SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField(ITEMS, T.ArrayType(T.StringType())),
    ])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = test_blocks(benchmark, width, block_words)
    block, state = next(blocks, None) or TestBlock([], width), docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))

    def worker(block: TestBlock, passed: list[str], first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners = block.owners
            reach = np.array([len(w) // 4 for w in block.windows], np.int64)
            for batch, sizes, starts, search in _shards(batches, block):
                place, of = search.occurrences()
                rows = batch.num_rows
                spans: list[list] = [[] for _ in range(rows)]
                items: list[set] = [set() for _ in range(rows)]
                if not first:
                    spans = [[(x["start"], x["end"]) for x in s] for s in batch.column(SPANS).to_pylist()]
                    items = [set(x) for x in batch.column(ITEMS).to_pylist()]
                if len(place):
                    doc = np.searchsorted(starts, place, "right") - 1
                    cover = np.zeros(len(search.ids) + 1, np.int64)
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + reach[of], -1)
                    inside = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
                    turn = np.diff(inside)
                    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                    home = np.searchsorted(starts, a, "right") - 1
                    for r, x, y in zip(home.tolist(), (a - starts[home]).tolist(), (b - starts[home]).tolist(), strict=True):
                        spans[r].append((x, y))
                    for r, w in np.unique(np.stack([doc, of], 1), axis=0).tolist():
                        items[r].update(block.names[k] for k in owners[w] if block.names[k] is not None)
                out = [batch.column(c) for c in passed]
                out += [
                    pa.array(sizes, pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in _merge(s)] for s in spans], span_type),
                    pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(out, [*passed, WORDS, SPANS, ITEMS])

        return work

    first = True
    while block is not None:
        later = next(blocks, None)
        passed = keep if later is None or "text" in keep else [*keep, "text"]
        kinds = T.StructType([state.schema[c] for c in passed] + found.fields)
        state = map_arrow(state, worker(block, passed, first), kinds)
        if later is not None:  # one pass a block: the state of the documents lies in the shared folder
            state = written(state, run_folder(spark, "decontaminate"))
        block, first = later, False
    return state


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per test item its longest verbatim match of a whole window or more, and where it is.

    Each shard gives its best match per item, so the shuffle carries items, not documents.
    """
    spark = docs.sparkSession
    out = None
    for block in test_blocks(benchmark, width, block_words):

        def work(batches: Iterator[pa.RecordBatch], block: TestBlock = block) -> Iterator[pa.RecordBatch]:
            for batch, _, starts, search in _shards(batches, block):
                names = batch.column("doc_id").to_pylist()
                best: dict[int, tuple] = {}
                for k, at, length, place in search.longest():
                    doc = int(np.searchsorted(starts, place, "right") - 1)
                    pos = place - int(starts[doc])
                    one = ((names[doc] is not None, names[doc] or 0, pos, at), (block.names[k], at, length, names[doc], pos))
                    best[k] = min(best.get(k, one), one, key=lambda x: x[0])
                rows = [row for _, row in best.values()]
                kinds = [pa.string(), *[pa.int64()] * 4]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in MATCH_SCHEMA.split(", ")])

        part = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], MATCH_SCHEMA)
    best = F.min(F.struct(-F.col("length"), "doc_id", "doc_pos", "item_pos")).alias("b")
    return out.groupBy("item_id").agg(best).select(
        "item_id", F.col("b.item_pos"), (-F.col("b.col1")).alias("length"), F.col("b.doc_id"), F.col("b.doc_pos")
    )


def n_hit():
    return F.aggregate(SPANS, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated():
    """A twentieth of the words or more lie in windows of the test set."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col(WORDS))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    marked = mark(wrapped(docs), benchmark, width, keep=[ROW, "text"])
    return unwrapped(marked.where(~contaminated()), docs.columns)


@query(
    "op1_decontamination",
    r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), occ AS (
  SELECT DISTINCT doc_id, i, p.n, item_id FROM p JOIN win ON p.n = win.n AND p.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        F.col(WORDS).alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query(
    "op1_longest_matches",
    r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, j, least(13, len(w)) AS n, array_to_string(w[j : j + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), occ AS (
  SELECT item_id, j, doc_id, i, p.n, j - row_number() OVER (PARTITION BY item_id, doc_id, p.n, i - j ORDER BY j) AS island
  FROM p JOIN win ON p.n = win.n AND p.k = win.k
), runs AS (
  SELECT item_id, doc_id, min(j) - 1 AS item_pos, min(i) - 1 AS doc_pos, count(*) + n - 1 AS length
  FROM occ GROUP BY item_id, doc_id, n, i - j, island
)
SELECT item_id::VARCHAR AS item_id, item_pos, length, doc_id, doc_pos FROM runs
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length DESC, doc_id, doc_pos, item_pos) = 1
""",
)
def op1_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
