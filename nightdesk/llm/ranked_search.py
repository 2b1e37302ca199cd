"""Ranked lexical search over an index of geometrically blocked posting lists.

Documents are scanned once: each leaves a sparse vector of the terms that some item asks for, and
the corpus counts (documents with a term, terms, documents per term) are summed over all rows.
Vectors are then worked off in shards of whole documents.  In a shard every posting list that is
needed is clustered by the similarity of its documents and cut into blocks, and every block keeps
the coordinatewise maximum of its documents' vectors.  An item visits the blocks of its terms; a
block is skipped only if the exact bound from its maxima stays below the item's tenth best score so
far, and a list is skipped only if all maxima of the lists that are left stay below it together.
Each shard gives its best documents per item, and a window ranks what the shards gave.

A first pass over one shard in ``FLOOR_SHARE`` finds a score per item that ten documents are known
to reach; the pass over all shards starts from it, so most shards give nothing for most items.  It
is a lower bound from real documents and never changes the result.

Only the vectors' similarity is approximated (a projection on ``AXES`` axes): it shapes the blocks,
not the scores, which are whole numbers.  The items are worked off in blocks of at most
``BLOCK_TERMS`` distinct terms, which is all that the tasks are sent; a shard has at most
``SHARD_CELLS`` cells (documents times terms).

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's length factor m is
100 - 75 + (75 n N) div L; the score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over an item's
terms, repeats included.

Null and empty texts have no terms: such a document is found by nothing and counts for nothing, such
an item finds nothing.  Equal scores are ordered by ``doc_id``, nulls last; repeated documents are
ranked one by one, as are repeated items (told apart by ``item``, their number).  Other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, pieces, texts_of, word_table

TOP = 10
BLOCK_TERMS = 1 << 14
SHARD_CELLS, SHARD_DOCS = 1 << 24, 4096
BLOCK_DOCS = 24
AXES = 64
FLOOR_SHARE = 32
LAST = np.iinfo(np.int64).max
VECTORS = "doc_id long, size long, terms binary, tfs binary, docs long, words long, dfs binary"
HITS = "item long, doc_id long, score long"


def split_terms(text: bytes) -> list[bytes]:
    return text.translate(word_table()).replace(b"\0", b" ").split()


class ItemBlock:
    """Some items as counted term numbers."""

    def __init__(self, items: list[tuple[int, Counter]]):
        self.numbers = [n for n, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for _, counted in items:
            self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counted], np.int64))
            self.times.append(np.array(list(counted.values()), np.int64))


def item_blocks(items: DataFrame) -> Iterator[tuple[ItemBlock, list[str | None]]]:
    """Blocks of items with the ids that belong to their numbers; the driver holds one at a time."""
    held, ids, seen, number = [], {}, set(), 0
    for name, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        counted = Counter(split_terms((text or "").encode()))
        if held and len(seen | set(counted)) > BLOCK_TERMS:
            yield ItemBlock(held), ids
            held, ids, seen = [], {}, set()
        if counted:
            held.append((number, counted))
            ids[number] = name
            seen |= set(counted)
        number += 1
    if held:
        yield ItemBlock(held), ids


def vectors(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """A row per document that holds a term of the block, and rows of counts over all documents of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = block.vocabulary, [c.split()[0] for c in VECTORS.split(", ")]
        counts, filled, total = np.zeros(len(number), np.int64), 0, 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for doc, text in zip(ids, texts_of(batch.column("text")), strict=True):
                    words = split_terms(text)
                    filled, total = filled + bool(words), total + len(words)
                    terms, tfs = np.unique(np.array([number[w] for w in words if w in number], "<u4"), return_counts=True)
                    if len(terms):
                        counts[terms] += 1
                        rows.append((doc, len(words), terms.tobytes(), tfs.astype("<u4").tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                none = [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *none], names)
        if total:
            none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            last = [pa.array([filled], pa.int64()), pa.array([total], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *last], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, VECTORS)


def corpus_counts(rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents per term of the block.

    The tasks' rows are added in lanes, so that no task reads all of them; 64 rows come back.
    """

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, dfs = 0, 0, np.zeros(terms, np.int64)
        for part in parts:
            docs, words = docs + sum(part.column("docs").to_pylist()), words + sum(part.column("words").to_pylist())
            for one in part.column("dfs").to_pylist():
                dfs += np.frombuffer(one, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words]), pa.array([dfs.tobytes()], pa.binary())], ["docs", "words", "dfs"])

    counts = rows.where("docs IS NOT NULL").select("docs", "words", "dfs")
    summed = map_arrow(counts.repartition(64), add, "docs long, words long, dfs binary").collect()
    dfs = sum((np.frombuffer(r["dfs"], "<i8") for r in summed), np.zeros(terms, np.int64))
    return sum(r["docs"] for r in summed), sum(r["words"] for r in summed), dfs


def term_weights(documents: int, dfs: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in dfs.tolist()], np.int64)


class Blocks:
    """The blocks of one posting list: documents in block order, where blocks begin, their maxima."""

    def __init__(self, shard: Shard, term: int, coordinates: np.ndarray):
        docs = np.flatnonzero(shard.cells[:, shard.column[term]])
        count = -(-len(docs) // BLOCK_DOCS)
        if count > 1:  # each document goes to the most similar of evenly drawn centres
            near = shard.places[docs] @ shard.places[docs[:: -(-len(docs) // count)]].T
            home = near.argmax(axis=1)
            docs = docs[np.argsort(home, kind="stable")]
            home.sort()
            self.first = np.flatnonzero(np.diff(home, prepend=-1))
        else:
            self.first = np.zeros(1, np.int64)
        self.docs, self.ends = docs, np.append(self.first[1:], len(docs))
        self.coordinates = coordinates
        self.maxima = np.maximum.reduceat(shard.cells[np.ix_(docs, shard.column[coordinates])], self.first, axis=0)

    def bounds(self, terms: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """For each block the most that a document in it can score."""
        return self.maxima[:, np.searchsorted(self.coordinates, terms)].astype(np.int64) @ factor


class Shard:
    """Whole documents as a table of saturated term counts."""

    def __init__(self, names: list, sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], documents: int, words: int):
        self.order = np.array([LAST if n is None else n for n in names], np.int64)
        self.names = names
        m = 25 + (75 * sizes * documents) // words
        row = np.repeat(np.arange(len(names)), [len(t) for t in terms])
        tf, all_terms = np.concatenate(tfs).astype(np.int64), np.concatenate(terms).astype(np.int64)
        self.present, place = np.unique(all_terms, return_inverse=True)
        self.column = np.full(int(self.present[-1]) + 1, -1, np.int64)
        self.column[self.present] = np.arange(len(self.present))
        self.cells = np.zeros((len(names), len(self.present)), np.int32)  # at most 10^6
        self.cells[row, place] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        self.most = self.cells.max(axis=0).astype(np.int64)
        rng = np.random.default_rng(0)
        axes = rng.choice(np.array([-1, 1], np.float32), (len(self.present), AXES)) / np.sqrt((self.cells > 0).sum(axis=0))[:, None].astype(np.float32)
        places = np.zeros((len(names), AXES), np.float32)
        for a in range(0, len(names), 256):
            places[a : a + 256] = self.cells[a : a + 256].astype(np.float32) @ axes
        length = np.linalg.norm(places, axis=1, keepdims=True)
        self.places = places / np.where(length > 0, length, 1)
        self.blocks: dict[int, Blocks] = {}

    def holds(self, terms: np.ndarray) -> np.ndarray:
        return np.isin(terms, self.present)

    def search(self, terms: np.ndarray, factor: np.ndarray, floor: int, related: dict[int, np.ndarray], top: int) -> list[tuple]:
        """The best documents of one item as (score, doc_id), none of them below ``floor``.

        ``factor`` is weight times occurrences per term; ``related`` gives for each term all terms that
        items ask for together with it.
        """
        here = self.holds(terms)
        terms, factor = terms[here], factor[here]
        best_of = factor * self.most[self.column[terms]]
        order = np.argsort(-best_of, kind="stable")
        rest = np.append(np.cumsum(best_of[order][::-1])[::-1], 0)
        columns = self.column[terms]
        seen = np.zeros(len(self.names), bool)
        best_docs, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, which in enumerate(order.tolist()):
            if rest[at] < max(floor, 1):
                break
            term = int(terms[which])
            if term not in self.blocks:
                near = related[term]
                self.blocks[term] = Blocks(self, term, near[self.holds(near)])
            blocks = self.blocks[term]
            bounds = blocks.bounds(terms, factor)
            for chosen in (bounds == bounds.max(), bounds < bounds.max()):  # the likeliest blocks first, to raise the floor
                chosen = np.flatnonzero(chosen & (bounds >= max(floor, 1)))
                if not len(chosen):
                    continue
                docs = np.concatenate([blocks.docs[blocks.first[b] : blocks.ends[b]] for b in chosen.tolist()])
                docs = docs[~seen[docs]]
                seen[docs] = True
                scores = self.cells[np.ix_(docs, columns)].astype(np.int64) @ factor
                fits = scores >= max(floor, 1)
                best_docs, best_scores = np.concatenate([best_docs, docs[fits]]), np.concatenate([best_scores, scores[fits]])
                if len(best_docs) > top:
                    keep = np.lexsort((self.order[best_docs], -best_scores))[:top]
                    best_docs, best_scores = best_docs[keep], best_scores[keep]
                if len(best_docs) == top:
                    floor = max(floor, int(best_scores.min()))
        return [(int(s), self.names[d]) for s, d in zip(best_scores.tolist(), best_docs.tolist(), strict=True)]


def shard_hits(rows: DataFrame, block: ItemBlock, documents: int, words: int, weights: np.ndarray, floors: dict[int, int], top: int) -> DataFrame:
    """``item, doc_id, score``: what each shard of ``rows`` has for each item, at most ``top`` each."""
    most = min(SHARD_DOCS, max(64, SHARD_CELLS // max(1, len(block.vocabulary))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together: dict[int, list[np.ndarray]] = {}
        for terms in block.terms:
            for t in terms.tolist():
                together.setdefault(t, []).append(terms)
        related = {t: np.unique(np.concatenate(x)) for t, x in together.items()}
        held: list[tuple] = []

        def solved() -> pa.RecordBatch:
            names, sizes, terms, tfs = zip(*held, strict=True)
            shard = Shard(list(names), np.array(sizes, np.int64), [np.frombuffer(t, "<u4") for t in terms], [np.frombuffer(t, "<u4") for t in tfs], documents, words)
            out = [
                (number, doc, score)
                for number, terms, times in zip(block.numbers, block.terms, block.times, strict=True)
                for score, doc in shard.search(terms, times * weights[terms], floors.get(number, 1), related, top)
            ]
            columns = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "terms", "tfs")), strict=True):
                held.append(row)
                if len(held) == most:
                    yield solved()
                    held = []
        if held:
            yield solved()

    return map_arrow(rows.where("docs IS NULL").select("doc_id", "size", "terms", "tfs"), work, HITS)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, item, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark, out = docs.sparkSession, None
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block, ids in item_blocks(items):
        folder = run_folder(spark, "search")
        rows = written(vectors(docs, block), f"{folder}/vectors")
        documents, words, dfs = corpus_counts(rows, len(block.vocabulary))
        if not documents:
            continue
        weights = term_weights(documents, dfs)
        sample = rows.where(F.pmod(F.xxhash64("terms", "tfs"), F.lit(FLOOR_SHARE)) == 0)
        known = shard_hits(sample, block, documents, words, weights, {}, top)
        known = known.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") == top).select("item", "score")
        floors = {r["item"]: r["score"] for r in known.collect()}  # a row per item of the block at most
        found = written(shard_hits(rows, block, documents, words, weights, floors, top), f"{folder}/hits")
        found = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(ids.items()), "number long, item_id string")
        found = found.join(names, F.col("item") == F.col("number")).select("item_id", "item", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id string, item long, rank int, doc_id long, score long") if out is None else out


@query(
    "op11_ranked_search",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT row_number() OVER () AS i, item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT i, item_id, t, count(*) AS times FROM b GROUP BY i, item_id, t
), size AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), p AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, n, t
), weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, size GROUP BY t
), scored AS (
  SELECT i, item_id, r, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN p USING (t) JOIN weight USING (t), size GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0
)
SELECT item_id, k::INT AS rank, doc_id, score FROM ranked WHERE k <= 10
""",
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    found = search(table(spark, sf_dir, "documents"), items)
    return found.select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", "doc_id", "score")
