"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams of its lower-cased words, weighted by log frequency and
inverse document frequency and normalised.  Each language's labelled texts are clustered into
a few centroids; a text takes the language of the centroid with the highest cosine.  It is marked
rejected when it lies farther from that centroid than nearly all of the texts it was made from.

Inverse document frequencies come from every labelled text.  The clustering uses a sample of about
``PER_LANGUAGE`` texts per language, drawn by a hash of the id.

Null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled
text exists.  Ties go to the language that sorts first.  Rows without ``doc_id`` are predicted but
not learned from; repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, pieces, texts_of, word_table

DIMENSIONS = 2048
SIZES = (2, 3, 4)
PER_LANGUAGE = 1500
CENTROIDS = 4
UNDETERMINED = "und"
LANGUAGE, SIMILARITY, REJECTED = "nd_lang", "nd_lang_score", "nd_lang_rejected"


def frequencies(texts: list[bytes]) -> np.ndarray:
    """How often each hashed n-gram occurs in each text; words are framed by one separator."""
    table = word_table()
    data = b"\0\0\0".join(t.translate(table) for t in texts) + b"\0\0\0"
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) + 3 for t in texts])
    of = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSIONS, np.diff(ends, prepend=0))
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    gram = codes
    for k in range(1, max(SIZES)):
        gram = (gram[:-1] << np.uint32(8)) | codes[k:]
        if k + 1 not in SIZES:
            continue
        # Blank only at its ends: no n-gram crosses words or texts.
        keep = (codes[: len(gram)] > 0) | (codes[1 : len(gram) + 1] > 0)
        for inner in range(1, k):
            keep &= codes[inner : len(gram) + inner] > 0
        slot = (gram[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
        out += np.bincount(of[: len(gram)][keep] + slot, minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    length = np.linalg.norm(weighted, axis=1, keepdims=True)
    return (weighted / np.where(length > 0, length, 1)).astype(np.float32)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices bounded in bytes and rows, as the counts take a fixed space per row."""
    for part in pieces(batch, "text", 1 << 20):
        for at in range(0, part.num_rows, 512):
            yield part.slice(at, 512)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means, started from the mean and then the farthest rows."""
    centres = [rows.mean(axis=0)]
    while len(centres) < min(k, len(rows)):
        near = np.max(rows @ np.stack(centres).T, axis=1)
        centres.append(rows[int(np.argmin(near))])
    centres = np.stack(centres)
    for _ in range(rounds):
        home = np.argmax(rows @ centres.T, axis=1)
        for c in range(len(centres)):
            mine = rows[home == c]
            if len(mine):
                mean = mine.mean(axis=0)
                centres[c] = mean / max(1e-12, np.linalg.norm(mean))
    return centres


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """The model: idf, centroids with their languages (sorted), and the cosine below which to reject."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = known.where(known.doc_id.isNotNull() & known.lang.isNotNull() & known.text.isNotNull() & ~held_out(known.doc_id))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return {"languages": []}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000
    chosen = known.select("lang", "text", (draw < share[F.col("lang")]).alias("drawn"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = np.zeros(DIMENSIONS, np.int64)
        names = ["lang", "counts", "slot", "documents"]
        for whole in batches:
            for batch in _groups(whole):
                counts = frequencies(texts_of(batch.column("text")))
                documents += (counts > 0).sum(axis=0)
                drawn = np.flatnonzero(np.asarray(batch.column("drawn").to_pylist(), bool))
                none = pa.nulls(len(drawn), pa.int64())
                rows = pa.array([counts[k].astype("<f4").tobytes() for k in drawn.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(drawn)), rows, none, none], names)
        none = [pa.nulls(DIMENSIONS, k) for k in (pa.string(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(DIMENSIONS)), pa.array(documents)], names)


    counted = written(map_arrow(chosen, work, "lang string, counts binary, slot long, documents long"), f"{run_folder(docs.sparkSession, 'language')}/counts")
    total = sum(sizes.values())
    frequency = counted.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("documents").alias("n")).toPandas()
    idf = np.zeros(DIMENSIONS, np.float32)
    idf[frequency["slot"].to_numpy(int)] = np.log((1 + total) / (1 + frequency["n"].to_numpy(float))) + 0.05

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        rows = vectors(np.stack([np.frombuffer(x, "<f4") for x in part["counts"]]), idf)
        rows = rows[np.abs(rows).sum(axis=1) > 0]
        if not len(rows):
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        centres = cluster(rows, centroids)
        cosines = rows @ centres.T
        home, near = np.argmax(cosines, axis=1), np.max(cosines, axis=1)
        least = [float(np.quantile(near[home == c], 0.001)) if (home == c).any() else 1.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres], "least": least})

    learned = counted.where("counts IS NOT NULL").groupBy("lang").applyInPandas(learn, "lang string, centre binary, least double")
    found = learned.toPandas().sort_values(["lang", "centre"], ignore_index=True)  # a few rows per language
    return {
        "languages": found["lang"].tolist(),
        "centres": np.stack([np.frombuffer(x, "<f4") for x in found["centre"]]) if len(found) else None,
        "least": found["least"].to_numpy(float),
        "idf": idf,
    }


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with language, cosine and whether the text is too far off.

    Columns of the names of the results are replaced.
    """
    keep = [c for c in docs.columns if c not in (LANGUAGE, SIMILARITY, REJECTED)] if keep is None else keep
    kinds = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField(LANGUAGE, T.StringType()), T.StructField(SIMILARITY, T.DoubleType()), T.StructField(REJECTED, T.BooleanType())
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(model["languages"], object)
        for whole in batches:
            for batch in _groups(whole):
                lettered = np.asarray(batch.column("nd_letter").to_pylist(), bool)
                if len(languages):
                    cosines = vectors(frequencies(texts_of(batch.column("text"))), model["idf"]) @ model["centres"].T
                    best = np.argmax(cosines, axis=1)
                    near = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
                    names, far = languages[best], near < model["least"][best]
                else:
                    names, near, far = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                names, near, far = np.where(lettered, names, UNDETERMINED), np.where(lettered, near, 0.0), far | ~lettered
                out = [batch.column(c) for c in keep] + [pa.array(names.tolist(), pa.string()), pa.array(near), pa.array(far)]
                yield pa.RecordBatch.from_arrays(out, [*keep, LANGUAGE, SIMILARITY, REJECTED])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("nd_letter")
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]), letter), work, kinds)


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs), keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(LANGUAGE).alias("lang_pred"),
        F.col(SIMILARITY).alias("score"),
        F.col(REJECTED).alias("rejected"),
    )
