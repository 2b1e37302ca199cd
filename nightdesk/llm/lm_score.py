"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models join a unigram and a bigram model with equal weight in the logarithm, over one
vocabulary: the words and word pairs that occur at least ``LEAST_COUNT`` times in all documents;
the rest of an order is one unknown gram.  The background model counts all documents, the target
model all of those labelled as good; the target is smoothed towards the background with a
Dirichlet prior.  The score of a document is the mean over
its words of target loss minus background loss, in nats; lower means closer to the target.

Words, pairs and contexts (the words before) are counted under keys of their own.  Keys are dealt
over ranges by mixed bits, so the pairs of one frequent word lie in as many tasks as there are.  A
pair's key names its context by ``CONTEXT_BITS`` bits; the counts of contexts are joined to the known
pairs.  Words whose contexts share these bits (one in a hundred of 10^7 words) share one total.
Counts travel to the reducers as sorted blocks, a row per flush and range of keys, straight through
the shuffle; their volume, the model and the rows it is joined to grow with the input.

Losses are doubles and the same whichever way they reach the documents: a vocabulary of up to
``CARRIED`` grams is looked up in the tasks, a larger one is joined by key.

Null texts and texts without words have score 0 and no words.  Repeated rows count and are scored
one by one, whatever their ``doc_id``.  Without target documents every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import hash_words, map_arrow, mix, pieces, texts_of, word_table

LEAST_COUNT = 20
PRIOR = 5.0
CONTEXT_BITS = 30
RANGE_BITS = 12
GROUP_BYTES = 8 << 20
ONE, TWO, BEFORE = (np.uint64(k) for k in range(3))
FILTER_BITS = 25
MERGE = 1 << 20
CARRIED = 4_000_000
ROOT = np.uint64(0xA5A5A5A5A5A5A5A5)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its text, its key, the key of its pair and the key of its context; the two lowest bits tell the kind."""
    of, words = hash_words(texts, word_table())
    before = np.empty_like(words)
    if len(words):
        before[0], before[1:] = ROOT, words[:-1]
        before[np.flatnonzero(np.diff(of, prepend=-1))] = ROOT
    low = np.uint64(CONTEXT_BITS + 2)
    context = before >> np.uint64(64 - CONTEXT_BITS) << np.uint64(2)
    pair = (mix(before * np.uint64(3) + words) >> low << low) | context | TWO
    return of, words & ~np.uint64(3) | ONE, pair, (mix(context) >> low << low) | context | BEFORE


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, so that the shuffle's compression finds the zeros."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=0, dtype=counts.dtype) if len(first) else counts


def count_grams(docs: DataFrame) -> DataFrame:
    """``range, keys, counts``: blocks of sorted keys with target and total counts, from text and target flag."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            edges = np.searchsorted(keys, np.arange(1 << RANGE_BITS, dtype=np.uint64) << np.uint64(64 - RANGE_BITS))
            spans = [(r, a, b) for r, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([r for r, *_ in spans], pa.int64()), pa.array([_packed(keys[a:b]) for _, a, b in spans], pa.binary()),
                 pa.array([np.ascontiguousarray(counts[a:b].T).astype("<u4").tobytes() for _, a, b in spans], pa.binary())],
                ["range", "keys", "counts"],
            )

        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                of, *kinds = grams(texts_of(batch.column("text")))
                target = np.asarray(batch.column("target").to_pylist(), np.uint32)[of]
                keys = np.concatenate(kinds)
                held.append(_summed(keys, np.stack([np.tile(target, 3), np.ones(len(keys), np.uint32)], 1)))
                size += len(held[-1][0])
                if size > MERGE:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return map_arrow(docs, work, "range long, keys binary, counts binary")


def model(blocks: DataFrame, text_bytes: int) -> DataFrame:
    """``key, kind, target, every`` of each gram of the vocabulary and of each context of a pair in it.

    Per group of ranges and kind, the counts of all rare grams come as a row with a null key.
    """

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unpacked(x) for x in part["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u4").reshape(2, -1).T for x in part["counts"]]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        kind = (keys & np.uint64(3)).astype(np.int64)
        known = counts[:, 1] >= LEAST_COUNT  # a context occurs as often as any of its pairs
        rare = [counts[~known & (kind == k)].sum(axis=0) for k in range(3)]
        return pd.DataFrame({
            "key": pd.array([*keys[known].view(np.int64).tolist(), None, None, None], "Int64"),
            "kind": [*kind[known].tolist(), 0, 1, 2],
            "target": [*counts[known, 0].tolist(), *(r[0] for r in rare)],
            "every": [*counts[known, 1].tolist(), *(r[1] for r in rare)],
        })

    wide = max(0, RANGE_BITS - max(5, math.ceil(math.log2(text_bytes / GROUP_BYTES + 1))))  # ranges that go together
    grouped = blocks.withColumn("group", F.shiftright("range", wide)).groupBy("group")
    return grouped.applyInPandas(reduce, "key long, kind int, target long, every long")


def loss_difference(t, n, all_t, all_n):
    """-log target + log background; the target's prior is ``PRIOR`` occurrences dealt as in the background."""
    return F.log(n / all_n) - F.log((t + PRIOR * n / all_n) / (all_t + PRIOR))


def vocabulary(blocks: DataFrame, text_bytes: int, folder: str) -> tuple[DataFrame, dict[bool, float], int]:
    """``key, two, loss`` of the known grams, the loss of the unknown gram per order, and the target's words."""
    counts = written(model(blocks, text_bytes), f"{folder}/counts")
    sums = counts.where("kind < 2").groupBy("kind").agg(
        F.sum("target").alias("t"), F.sum("every").alias("n"),
        F.sum(F.when(F.col("key").isNull(), F.col("target")).otherwise(0)).alias("ut"),
        F.sum(F.when(F.col("key").isNull(), F.col("every")).otherwise(0)).alias("un"),
    )
    sums = {r["kind"]: r for r in sums.collect()}  # two rows
    blank = {two: 0.0 for two in (False, True)}
    for kind, r in sums.items():
        if r["un"]:
            share = r["un"] / r["n"]
            blank[kind == 1] = math.log(share) - math.log((r["ut"] + PRIOR * share) / (r["t"] + PRIOR))
    all_t, all_n = (int(sums[0][c]) if 0 in sums else 0 for c in ("t", "n"))
    known = counts.where("key IS NOT NULL")
    context = F.shiftright("key", 2).bitwiseAND(F.lit((1 << CONTEXT_BITS) - 1))
    before = known.where("kind = 2").select(context.alias("of"), F.col("target").alias("of_t"), F.col("every").alias("of_n"))
    pairs = known.where("kind = 1").withColumn("context", context).join(before.hint("merge"), F.col("context") == F.col("of"))
    two = pairs.select("key", F.lit(True).alias("two"), loss_difference(F.col("target"), F.col("every"), F.col("of_t"), F.col("of_n")).alias("loss"))
    one = known.where("kind = 0").select("key", F.lit(False).alias("two"), loss_difference(F.col("target"), F.col("every"), F.lit(all_t), F.lit(all_n)).alias("loss"))
    return written(one.unionByName(two), f"{folder}/vocabulary"), blank, all_t


def flagged(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``text, target`` of every row; ``good`` are distinct ids, none of them null.

    A bit filter of fixed size over the ids keeps the texts of most other rows out of the shuffle;
    the join that follows is exact, so the filter's size never changes the result.
    """
    bit = F.shiftrightunsigned(F.xxhash64("good"), 64 - FILTER_BITS)
    marks = good.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    bit = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    asked = rows.withColumn("bit", bit).join(F.broadcast(marks), F.shiftright("bit", 6) == F.col("word"), "left")  # 2**19 rows at most
    may = F.coalesce(F.col("doc_id").isNotNull() & F.expr("(shiftrightunsigned(bits, CAST(bit & 63 AS INT)) & 1) = 1"), F.lit(False))
    met = asked.where(may).join(good, F.col("doc_id") == F.col("good"), "left").select("text", F.col("good").isNotNull().cast("long").alias("target"))
    return met.unionByName(asked.where(~may).select("text", F.lit(0).cast("long").alias("target")))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, words, score`` of every row; ``target`` lists the ids of the target documents."""
    folder = run_folder(docs.sparkSession, "lm")
    good = target.select(F.col("doc_id").cast("long").alias("good")).where("good IS NOT NULL").distinct()
    good = written(good, f"{folder}/good")  # so the join shuffles both sides anew and a hot id can be split
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # decides how many groups count
    known, blank, target_words = vocabulary(count_grams(flagged(rows, good)), text_bytes, folder)
    # A vocabulary of up to ``CARRIED`` grams (16 bytes each) goes to the tasks; beyond that it is joined.
    summed = (_carried if known.count() <= CARRIED else _joined)(rows, known)
    unknown = (F.col("words") - F.col("n_one")) * blank[False] + (F.col("words") - F.col("n_two")) * blank[True]
    mean = F.when(F.col("words") > 0, (F.col("total") + unknown) / (2 * F.col("words"))).otherwise(0.0)
    return summed.select("doc_id", "words", (mean if target_words else F.lit(0.0)).alias("score"))


def _carried(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, words, total, n_one, n_two``: summed loss and number of known grams, by lookup in sorted arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.asarray(batch.column("key")).tobytes(), np.asarray(batch.column("loss")).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in arrays], ["keys", "losses"])

    # At most ``CARRIED`` grams of 16 bytes, as packed arrays rather than rows.
    found = map_arrow(known.select("key", "loss"), pack, "keys binary, losses binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in found), np.uint64)
    losses = np.frombuffer(b"".join(r["losses"] for r in found), np.float64)
    order = np.argsort(keys)
    keys, losses = keys[order], losses[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                of, *orders = grams(texts_of(batch.column("text")))[:3]
                size = batch.num_rows
                total, hits = np.zeros(size), []
                for asked in orders:
                    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                    hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                    hits.append(np.bincount(of[hit], minlength=size))
                    total += np.bincount(of[hit], weights=losses[at[hit]] if len(keys) else None, minlength=size)
                columns = [np.bincount(of, minlength=size), total, *hits]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "words", "total", "n_one", "n_two"])

    return map_arrow(rows, work, "doc_id long, words long, total double, n_one long, n_two long")


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a join on the key; only grams that a bit filter of fixed size lets through are shuffled."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    marks = known.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas()  # 2**19 rows at most
    held = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    held[marks["word"].to_numpy(int)] = marks["bits"].to_numpy(np.int64)
    packed = held.tobytes()
    names = ["row", "doc_id", "words", "key", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                of, one, two, _ = grams(texts_of(batch.column("text")))
                ids = np.asarray(batch.column("row").to_pylist(), np.int64)
                words = np.bincount(of, minlength=len(ids))
                # A row for the document itself, under a key of its own that spreads and meets nothing but by chance.
                alone = mix(ids.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), pa.array(words), pa.array(alone), pa.array(np.zeros(len(ids), np.int64))], names)
                both, keys = np.tile(of, 2), np.concatenate([one, two])
                keep = wanted[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                both, keys = both[keep], keys[keep]
                order = np.lexsort((keys, both))
                both, keys = both[order], keys[order]
                new = (np.diff(both, prepend=-1) != 0) | (np.diff(keys, prepend=~keys[:1]) != 0)
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(keys)))
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[both[first]]), none, none, pa.array(keys[first].view(np.int64)), pa.array(many, pa.int64())], names)

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = map_arrow(numbered, work, "row long, doc_id long, words long, key long, n long")
    met = parts.join(known.hint("merge"), "key", "left")

    one, two = (F.sum(F.when(F.col("two") == flag, F.col("n")).otherwise(0)) for flag in (False, True))
    total = F.coalesce(F.sum(F.col("n") * F.col("loss")), F.lit(0.0))
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("words").alias("words"), total.alias("total"), one.alias("n_one"), two.alias("n_two")
    )


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)
