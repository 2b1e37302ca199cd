"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits; each is the majority of that bit over the XXH64 hashes of all word
shingles of a text.  Two fingerprints link at ``RADIUS`` or fewer differing bits.  The bits are cut
into ``segments``; of the differing bits of a link, one segment holds at most RADIUS / segments.  So
every fingerprint is filed once per segment under that segment's bits, and looked up under all
values of a small Hamming ball around them; what meets is verified on all 64 bits.

Equal fingerprints are one node from the start.  A family of near copies has thousands of
fingerprints that all meet each other, so a first round links every bucket only with the
fingerprint that most of its rows have, and contracts what is linked.  The exact round then files
the fingerprints of a contracted group as lists of bounded length, and lists of one group are not
compared with each other.  No link between groups is missed, whatever the first round found.

Shorter segments mean fewer lookups, longer ones fewer false meetings: three segments (67 lookups)
suit up to some 10^8 fingerprints, two (1,058 lookups) more.  Both give the same groups.

Null texts and texts without words have fingerprint zero and link like any other; a text of fewer
words than a shingle is one shingle.  Repeated rows, also with a null ``doc_id``, are rows of one
node.  The component id is the smallest ``doc_id`` of the component, null if it has none.  Other
columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.graph import components
from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, pieces, texts_of

WIDTH, RADIUS, SEGMENTS, SEED = 4, 4, 3, 42
#: Fingerprints of one group that are filed together under a key, on average at most.
LIST = 256
SLICE_BYTES = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``SLICE_BYTES``."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + SLICE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _ones(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit, lowest first, and how many shingles there are."""
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    cut = (line[a:b] for a, b in zip(starts, ends[width - 1 :], strict=True))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, cut, repeat(SEED))), "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(hashes)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of one UTF-8 text."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for words in _word_slices(text.translate(LOWER)):
        held += words
        if len(held) >= width:
            more, n = _ones(held, width)
            ones, total = ones + more, total + n
            held = held[len(held) - width + 1 :]
    if not total:
        if not held:
            return 0
        ones, total = _ones(held, len(held))
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                prints = np.array([fingerprint(t, width) for t in texts_of(batch.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    edges = [round(64 * k / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _filed(fp: Column, count: int) -> list[Column]:
    """A struct of segment number and the bits of that segment, for each segment."""
    return [
        F.struct(F.lit(k).alias("seg"), fp.bitwiseAND(F.lit(_signed(((1 << n) - 1) << a))).alias("bits")) for k, (a, n) in enumerate(_segments(count))
    ]


def _ball(fp: Column, count: int, radius: int) -> list[Column]:
    """The same for all values within ``radius`` of each segment."""
    out = []
    for (a, n), key in zip(_segments(count), _filed(fp, count), strict=True):
        masks = [sum(1 << (a + i) for i in bits) for r in range(radius + 1) for bits in combinations(range(n), r)]
        out += [F.struct(key["seg"].alias("seg"), key["bits"].bitwiseXOR(F.lit(_signed(m))).alias("bits")) for m in masks]
    return out


def _near(x: Column, y: Column, radius: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= radius


def star_links(nodes: DataFrame, segments: int, radius: int) -> DataFrame:
    """Links ``a, b`` of fingerprints with the one that most rows have, among those equal in one segment or all but one."""
    ones = _filed(F.col("fp"), segments)
    rest = [
        F.struct(F.lit(segments + k).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (((1 << n) - 1) << a)))).alias("bits"))
        for k, (a, n) in enumerate(_segments(segments))
    ]
    filed = nodes.select("fp", "rows", F.explode(F.array(*ones, *rest)).alias("key")).select("fp", "rows", "key.*")
    centre = filed.groupBy("seg", "bits").agg(F.max(F.struct("rows", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1")
    centre = centre.select("seg", "bits", F.col("c.fp").alias("b"))
    met = filed.select(F.col("fp").alias("a"), "seg", "bits").join(centre.hint("merge"), ["seg", "bits"])
    return met.where((F.col("a") != F.col("b")) & _near(F.col("a"), F.col("b"), radius)).select("a", "b").distinct()


def _lists(groups: DataFrame, keys: list[Column]) -> DataFrame:
    """``seg, bits, comp, fps``: the fingerprints of a group under each key, in lists of bounded length."""
    alone = groups.where("size = 1").select("comp", F.array("fp").alias("fps"), F.explode(F.array(*keys)).alias("key"))
    many = groups.where("size > 1").select(
        "fp", "comp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / LIST)).alias("part"), F.explode(F.array(*keys)).alias("key")
    )
    many = many.select("fp", "comp", "part", "key.*").groupBy("seg", "bits", "comp", "part").agg(F.collect_list("fp").alias("fps"))
    return alone.select("key.*", "comp", "fps").unionByName(many.select("seg", "bits", "comp", "fps"))


def ball_links(groups: DataFrame, segments: int, radius: int) -> DataFrame:
    """Every pair ``a, b`` of groups with a link between their fingerprints, from ``fp, comp, size``."""
    held = _lists(groups, _filed(F.col("fp"), segments)).select("seg", "bits", F.col("comp").alias("a"), F.col("fps").alias("xs"))
    asked = _lists(groups, _ball(F.col("fp"), segments, radius // segments)).select("seg", "bits", F.col("comp").alias("b"), F.col("fps").alias("ys"))
    linked = F.exists("xs", lambda x: F.exists("ys", lambda y: _near(x, y, radius)))
    return held.join(asked.hint("merge"), ["seg", "bits"]).where((F.col("a") < F.col("b")) & linked).select("a", "b").distinct()


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp, component_id``."""
    folder = run_folder(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs, width), f"{folder}/rows")
    nodes = written(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")), f"{folder}/nodes")
    stars = components(written(star_links(nodes, segments, radius), f"{folder}/stars"), f"{folder}/one")
    named = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    named = written(named, f"{folder}/named")
    sizes = named.groupBy("comp").agg(F.count("*").alias("size"))
    placed = written(named.join(sizes.hint("merge"), "comp").select("fp", "comp", "size"), f"{folder}/placed")
    joined = components(written(ball_links(placed, segments, radius), f"{folder}/links"), f"{folder}/two")
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    whole = named.join(joined.hint("merge"), "comp", "left").select("fp", "first", F.coalesce("whole", "comp").alias("whole"))
    whole = written(whole, f"{folder}/whole")
    smallest = whole.groupBy("whole").agg(F.min("first").alias("component_id"))
    ids = written(whole.join(smallest.hint("merge"), "whole").select("fp", "component_id"), f"{folder}/ids")
    return rows.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
