"""Maximal periodic runs of words in documents, tiled by scale.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least max(6, 4 q) words that no neighbouring word extends keeping period q.  For a period q the
places i whose word equals the word at i + q form streaks; a run is a streak of max(6 - q, 3 q)
places or more whose root of q words is no repetition of a shorter word.

Periods are worked off by octaves B <= q < 2 B.  For each octave a document is cut into overlapping
tiles.  A streak that is long enough holds the 2 B places from some multiple of B on, a boundary.
So the scan compares hashes of 2 B words at every boundary with those of the next B to 2 B places
(one comparison per word and octave) and explodes the document into the tiles where they agree.
Tiles travel alone and are solved alone: the Z-function of the words from a boundary on tells which
periods hold there and which of their roots are primitive, and the streaks around the boundary are
taken as far as the tile reaches.  A tile reaches B words before and 4 B words behind its own
boundaries, so the fragments of one streak overlap; they are shuffled by document and period and
stitched.  Hashes only propose: every fragment is cut from compared words.

A document of any length is thus many small tiles of which a task solves any number, and only tiles
with repetition travel.  Documents without any are finished in the scan.

Null and empty texts have no words and no runs.  Repeated rows, also with a null ``doc_id``, are
worked off one by one.  Other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, mix, pieces, texts_of

#: Words of a tile between its overlaps: this many, or so many times the octave's shortest period.
TILE, TILE_PERIODS = 1024, 16
STEP = np.uint64(0x9E3779B97F4A7C15)
SCANNED = "row long, doc_id long, n_words long, words binary, digest string, octave int, first long, own long, length long, tile binary"
FRAGMENTS = "row long, period long, low long, high long"
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def tile_size(octave: int) -> int:
    return max(TILE, TILE_PERIODS << octave)


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.array([numbers[w] for w in words], np.uint32)


def proposals(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per octave a table (boundary, period - B) of the pairs whose 2 B words have equal hashes."""
    octave, step, hashes = 0, STEP[None], mix((ids.astype(np.uint64) + np.uint64(1)) * STEP)
    while 3 << octave <= len(ids):
        size = 1 << octave
        step = step * STEP
        hashes = hashes[:-size] * step + hashes[size:]  # of 2 B words
        rows = -(-len(hashes) // size)
        square = np.zeros(rows * size, np.uint64)
        square[: len(hashes)] = hashes
        square = square.reshape(rows, size)
        equal = square[1:] == square[:-1, :1]
        if equal.any():
            yield octave, equal
        octave += 1


def tiles(ids: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """Octave, first word, first boundary and words of each tile in which something repeats."""
    out = []
    for octave, equal in proposals(ids):
        at = np.flatnonzero(equal.any(axis=1)) << octave
        size = tile_size(octave)
        for own in (np.unique(at // size) * size).tolist():
            first = max(0, own - (1 << octave))
            out.append((octave, first, own, ids[first : own + size + (4 << octave)]))
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common beginning of ``s`` and of what starts there."""
    n = len(s)
    z, low, high = [0] * n, 0, 0
    z[0] = n
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def primitive(z: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The periods whose root, the words that ``z`` begins with, is no repetition of a shorter word."""
    shifts = np.arange(1, len(z))
    out = []
    for q in periods.tolist():
        root = int(np.argmax(z[1:q] >= q - shifts[: q - 1])) + 1 if q > 1 else 1
        repeats = root < q and z[root] >= q - root and q % root == 0
        out.append(not repeats)
    return periods[np.array(out, bool)]


def fragments(octave: int, ids: np.ndarray, own: int, size: int, starts: bool, ends: bool) -> list[tuple[int, int, int]]:
    """Period and extent of the streaks at the boundaries of one tile.

    ``own`` is the first boundary's place in the tile; ``starts`` and ``ends`` say whether the tile
    begins and ends with the document.  Streaks that are too short and touch no cut are left out.
    """
    base, out = 1 << octave, []
    equal = next((e for at, e in proposals(ids[own:]) if at == octave), np.zeros((0, base), bool))
    rows, shifts = np.nonzero(equal[: size >> octave])
    places, periods = own + (rows << octave), shifts + base
    while len(places):
        place = int(places[0])
        now = int(np.searchsorted(places, place, "right"))
        z = np.array(z_function(ids[place : place + 4 * base].tolist()), np.int64)
        here = periods[:now]
        here = here[z[here] >= np.minimum(2 * base, len(z) - here)]
        places, periods = places[now:], periods[now:]
        # What repeats with a shorter period here may do so for long; its multiples have no primitive root there.
        short = np.flatnonzero(z[1:base] >= 2 * base)
        if len(short):
            known = int(short[0]) + 1
            differs = np.flatnonzero(ids[place:-known] != ids[place + known :])
            end = (place + int(differs[0]) if len(differs) else len(ids) - known) + known
            here = here[(here % known != 0) | (place + here > end)]
            open_pairs = (periods % known != 0) | (places + periods > end)
            places, periods = places[open_pairs], periods[open_pairs]
        for q in primitive(z, here).tolist():
            same = ids[:-q] == ids[q:]
            if not same[place]:
                continue
            before, behind = np.flatnonzero(~same[:place]), np.flatnonzero(~same[place:])
            low = int(before[-1]) + 1 if len(before) else 0
            high = place + int(behind[0]) if len(behind) else len(same)
            cut = (low == 0 and not starts) or (high == len(same) and not ends)
            if cut or high - low >= max(6 - q, 3 * q):
                out.append((q, low, high))
            open_pairs = (periods != q) | (places >= high)
            places, periods = places[open_pairs], periods[open_pairs]
    return out


def scanned(docs: DataFrame, rewrite: Rewrite | None, texts: bool) -> DataFrame:
    """A row per document, with its words if anything repeats or ``texts``, and a row per tile."""
    names = [c.split()[0] for c in SCANNED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in SCANNED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                out = []
                rows, ids = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
                for row, doc, text in zip(rows, ids, texts_of(batch.column("text")), strict=True):
                    words = text.split()
                    if rewrite is not None:
                        words = rewrite(doc, words)
                    code = numbered(words)
                    cut = tiles(code)
                    line = b" ".join(words)
                    held = line if cut or texts else None
                    out.append((row, doc, len(words), held, None if cut else hashlib.sha256(line).hexdigest(), None, None, None, None, None))
                    for octave, first, own, part in cut:
                        out.append((row, None, None, None, None, octave, first, own, len(code), part.astype("<u4").tobytes()))
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    numbered_rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(numbered_rows, work, SCANNED)


def solved(cut: DataFrame) -> DataFrame:
    """``row, period, low, high``: the fragments of all tiles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, octave, first, own, length, tile in zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "first", "own", "length", "tile")), strict=True):
                ids = np.frombuffer(tile, "<u4")
                for q, low, high in fragments(octave, ids, own - first, tile_size(octave), first == 0, first + len(ids) == length):
                    out.append((row, q, first + low, first + high))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "low", "high"])

    dealt = cut.select("row", "octave", "first", "own", "length", "tile").repartition("row", "octave", "own")
    return map_arrow(dealt, work, FRAGMENTS)


def stitched(parts: DataFrame) -> DataFrame:
    """``row, start, period, length`` of every run, from fragments that overlap where they belong together."""
    by = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach >= F.col("low"), 0).otherwise(1)
    pieces = parts.withColumn("opens", opens).withColumn("part", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("row", "period", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    streak = F.col("high") - F.col("low")
    whole = whole.where(streak >= F.greatest(6 - F.col("period"), 3 * F.col("period")))
    return whole.select("row", F.col("low").alias("start"), "period", (streak + F.col("period")).alias("length"))


def _kept(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that lie in no run or among the first q words of every run they lie in."""
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, runs, collapsed_sha256`` and, if ``texts``, ``collapsed``.

    ``runs`` is ordered by start, then period.  ``collapsed`` joins by a space the words that no run
    contains after its first q words.  ``rewrite`` may change the words of a document beforehand.
    """
    folder = run_folder(docs.sparkSession, "runs")
    rows = written(scanned(docs, rewrite, texts), f"{folder}/scanned")
    found = written(stitched(solved(rows.where("tile IS NOT NULL"))), f"{folder}/runs")
    listed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    of_docs = rows.where("tile IS NULL").select("row", "doc_id", "n_words", "words", "digest")
    none = F.array().cast(RUNS)
    columns = ["doc_id", "n_words", "runs", "digest", "words"]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "words"):
                lines = [b" ".join(_kept(x.split(), r)) for x, r in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in lines])
                out = [batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), digests, pa.array(lines if texts else [None] * len(lines), pa.binary())]
                yield pa.RecordBatch.from_arrays(out, columns)

    open_docs = of_docs.where("digest IS NULL").join(listed.hint("merge"), "row", "left")
    open_docs = open_docs.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "words")
    changed = map_arrow(open_docs, collapse, f"doc_id long, n_words long, runs {RUNS}, digest string, words binary")
    plain = of_docs.where("digest IS NOT NULL").select("doc_id", "n_words", none.alias("runs"), "digest", "words")
    out = plain.unionByName(changed)
    more = [F.col("words").cast("string").alias("collapsed")] if texts else []
    return out.select("doc_id", "n_words", "runs", F.col("digest").alias("collapsed_sha256"), *more)


def runs_digest(runs: Column) -> Column:
    """SHA-256 of the lines ``start,length,period``."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


def repeated_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own rule: of a tenth of the documents the words from some place on repeat."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), repeated_tail).withColumn("most", longest(F.col("runs")))
    length = -F.col("most.less")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        length.alias("length"),
        F.col("most.period").alias("period"),
        F.floor(1000 * length / F.col("most.period")).cast("long").alias("exponent_milli"),
        runs_digest(F.col("runs")).alias("runs_sha256"),
        "collapsed_sha256",
    )
