"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words.  A word's score is its log-odds of toxic against clean text, estimated with
Dirichlet priors in a chain: the prior of a word is centred on its six-byte prefix, that of a
prefix on the four-byte one, and that one on the whole labelled text.  Minus a constant drift,
the scores of clean text are negative on average, so passages that stand out are the maximal
scoring segments, all found in one linear scan.  Extreme-value theory gives a segment's chance
in clean text (its slope from the score distribution, its constant from clean documents), the
segments of a document are summed up by the same theory, and a logistic curve fitted to held-back
labelled documents turns that into a score from 0 to 1.

Counts live in hashed tables of fixed size.  The model is fitted on at most ``MOST_LABELLED``
labelled documents, those with the smallest hash of their id; scoring covers all text.

Null and empty texts have no passages and get the score of a text without any.  Several labels of
one document count as toxic if one is.  Labels that are null, or of documents that are not there,
are ignored; without labels of both kinds every score is the share of toxic labels (or 0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightdesk.llm.registry import query, table
from nightdesk.llm.rows import ROW, unwrapped, wrapped
from nightdesk.llm.text import hash_words, map_arrow, pieces, texts_of, word_table

MOST_LABELLED = 20_000
PREFIXES = (4, 6)
SLOT_BITS = 18
PRIOR, DRIFT = 10.0, 1.0
CALIBRATE = 4  # one in so many labelled documents is held back for calibration
SCORE, PASSAGES = "nd_toxic_score", "nd_toxic_passages"


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Model:
    """Counts of toxic and all words per level and slot, then the calibration."""

    def __init__(self, toxic: np.ndarray, every: np.ndarray):
        self.toxic, self.every = toxic.astype(np.float32), every.astype(np.float32)
        whole = max(1.0, float(every[0].sum()))
        self.base = min(max(float(toxic[0].sum()) / whole, 1e-6), 1 - 1e-6)
        self.slope, self.constant, self.curve = 1.0, 1.0, (0.0, -20.0)

    def scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """Log-odds minus drift per word; ``levels`` are its hashes from the short prefix to the word."""
        share = np.float32(self.base)
        for k, hashes in enumerate(levels):
            slot = _slots(hashes)
            share = (self.toxic[k][slot] + PRIOR * share) / (self.every[k][slot] + PRIOR)
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - DRIFT

    def evidence(self, segments: list[float], words: int) -> float:
        """-log of the chance that clean text of this length has segments as good as the best r, for the best r."""
        if not segments or not words:
            return 0.0
        room = math.log(max(self.constant * words, 1e-9))
        best = total = 0.0
        for r, score in enumerate(sorted(segments, reverse=True), 1):
            total += self.slope * score - room
            if self.slope * score <= room or total <= 0:
                break
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * np.log1p(evidence) + shift, -30, 30)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Each candidate keeps its left and right cumulative sums and a link to the nearest earlier
    candidate with a smaller left sum, so no candidate is looked at again once it is passed.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    starts, ends, left, right, link = [], [], [], [], []
    for k, r, s in zip(at.tolist(), total[at].tolist(), scores[at].tolist(), strict=True):
        start, low = k, r - s
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= r:
                break
            start, low = starts[j], left[j]
            for x in (starts, ends, left, right, link):
                del x[j:]
        starts.append(start)
        ends.append(k + 1)
        left.append(low)
        right.append(r)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(starts, ends, left, right, strict=True)]


def _levels(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First word of each text (and the end), and the word hashes from short prefix to whole word."""
    of, word, *parts = hash_words(texts, word_table(), PREFIXES)
    return np.searchsorted(of, np.arange(len(texts) + 1)), [*parts, word]


def sample(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, toxic, calibrate`` of at most ``most`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    return once.orderBy(draw, "doc_id").limit(most).withColumn("calibrate", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def count_words(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and all words of the labelled texts per level and slot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = len(PREFIXES) + 1
        counts = np.zeros((2, levels << SLOT_BITS), np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                edges, hashes = _levels(texts_of(batch.column("text")))
                toxic = np.repeat(np.asarray(batch.column("toxic")), np.diff(edges))
                for k, h in enumerate(hashes):
                    slot = _slots(h) + (k << SLOT_BITS)
                    counts[1] += np.bincount(slot, minlength=counts.shape[1])
                    counts[0] += np.bincount(slot[toxic == 1], minlength=counts.shape[1])
        full = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[0][full]), pa.array(counts[1][full])], ["slot", "toxic", "words"])

    levels = len(PREFIXES) + 1
    summed = map_arrow(labelled, work, "slot long, toxic long, words long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("words").alias("words"))
    found = summed.toPandas()  # a row per slot at most
    out = np.zeros((2, levels << SLOT_BITS))
    out[0][found["slot"].to_numpy(int)] = found["toxic"].to_numpy(float)
    out[1][found["slot"].to_numpy(int)] = found["words"].to_numpy(float)
    return out[0].reshape(levels, -1), out[1].reshape(levels, -1)


def _slope(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of: mean of exp(slope * score) over clean words = 1."""
    share = counts / counts.sum()
    if not (values > 0).any() or (share * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * values)).sum() < 1 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a weak ridge."""
    design, weights = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * weights
        weights = weights + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), slope)
    return max(float(weights[0]), 1e-3), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    chosen = F.broadcast(sample(labels, most))  # at most ``most`` rows of three small columns
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "toxic", "calibrate")
    model = Model(*count_words(labelled.where("NOT calibrate").select("text", "toxic")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, low = 0.05, -12.0
        bins = np.zeros(600, np.int64)
        names = ["toxic", "words", "segments", "score", "count"]

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64()), strict=True)], names)

        for whole in batches:
            for batch in pieces(whole, "text"):
                edges, hashes = _levels(texts_of(batch.column("text")))
                scores, toxic = model.scores(hashes), batch.column("toxic").to_pylist()
                segments = []
                for a, b, bad in zip(edges[:-1], edges[1:], toxic, strict=True):
                    segments.append([s for _, _, s in maximal_segments(scores[a:b])])
                    if not bad:
                        bins += np.bincount(np.clip(((scores[a:b] - low) / step).astype(int), 0, 599), minlength=600)
                none = [None] * batch.num_rows
                yield rows(toxic, np.diff(edges), segments, none, none)
        full = np.flatnonzero(bins)
        none = [None] * len(full)
        yield rows(none, none, none, low + step * (full + 0.5), bins[full])

    held = map_arrow(labelled.where("calibrate").select("text", "toxic"), work, "toxic long, words long, segments array<double>, score double, count long")
    found = held.toPandas()  # a row per held-back document and score bin
    spread = found[found["score"].notna()]
    cases = found[found["toxic"].notna()]
    clean = cases[(cases["toxic"] == 0) & (cases["words"] > 0)]
    if not len(clean) or not (cases["toxic"] == 1).any() or not len(spread):
        share = float(cases["toxic"].mean()) if len(cases) else 0.0
        model.curve = (0.0, -30.0 if share <= 0 else 30.0 if share >= 1 else math.log(share / (1 - share)))
        return model
    model.slope = _slope(spread["score"].to_numpy(float), spread["count"].to_numpy(float))
    tops = np.array([max(s) if len(s) else 0.0 for s in clean["segments"]])
    model.constant = max(1e-6, len(clean) / float((clean["words"].to_numpy(float) * np.exp(-model.slope * tops)).sum()))
    evidence = np.array([model.evidence(list(s), int(n)) for s, n in zip(cases["segments"], cases["words"], strict=True)])
    model.curve = _logistic(np.log1p(evidence), cases["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with the score and the significant passages.

    A passage is ``start, end`` (words) and ``chance``, the expected number of such passages in
    clean text of this length; passages with a chance under 0.05 are listed.  Columns of
    the names of the results are replaced.
    """
    keep = [c for c in docs.columns if c not in (SCORE, PASSAGES)] if keep is None else keep
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("chance", T.DoubleType())])
    kinds = T.StructType([docs.schema[c] for c in keep] + [T.StructField(SCORE, T.DoubleType()), T.StructField(PASSAGES, T.ArrayType(passage))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                edges, hashes = _levels(texts_of(batch.column("text")))
                scores, evidence, passages = model.scores(hashes), [], []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    found, words = maximal_segments(scores[a:b]), b - a
                    evidence.append(model.evidence([s for _, _, s in found], words))
                    chances = [(x, y, model.constant * words * math.exp(-model.slope * s)) for x, y, s in found]
                    passages.append([{"start": x, "end": y, "chance": e} for x, y, e in chances if e < 0.05])
                out = [batch.column(c) for c in keep] + [pa.array(model.probability(np.array(evidence, float))), pa.array(passages, arrow)]
                yield pa.RecordBatch.from_arrays(out, [*keep, SCORE, PASSAGES])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    return map_arrow(chosen, work, kinds)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under one half, with their columns as they were."""
    scored = score(wrapped(docs), fit(docs, labels), keep=[ROW, "text"])
    return unwrapped(scored.where(F.col(SCORE) < 0.5), docs.columns)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"),
        F.size(PASSAGES).alias("passages"),
    )
