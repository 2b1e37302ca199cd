"""Near-duplicate groups by an exact n-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by a counting sketch of fixed size over the whole
corpus.  A document of s shingles that needs t of them in common with a partner shares at least
k of its first s - t + k shingles with it, and so does the partner.  Each document picks its own
k from the lengths of its lists: a longer prefix costs more list entries but leaves fewer
candidates.  Two documents are compared when they share at least the smaller of their two ks
among their prefixes and what can follow the last of these still suffices; the comparison
itself is exact.

Groups of thousands of near copies would make millions of pairs.  So the first round compares
every long list only with its most central member, links are contracted to components, and the
second round compares the pairs that are still in different components.  No component is missed:
a skipped pair already lies in one.  Equal shingle sets are one node from the start.

Links are then counted in full.  Both ends of a link lie in one component, so each component is
dealt into blocks of nodes, and each pair of blocks compares all its sets at once.  This grows
with the square of a component, as the links do.

Null texts and texts without words have no shingles, link with nothing and stand alone; a text
with fewer words than a shingle is one shingle.  Repeated rows, also with a null ``doc_id``, are
rows of one node.  The component id is the smallest ``doc_id`` of the component, null if it has none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.graph import components
from nightdesk.llm.registry import query, table
from nightdesk.llm.rows import decided
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, mix, pieces, shingle_sets, space_table, texts_of

WIDTH, PERCENT = 4, 85
SKETCH_BITS, CHUNK = 20, 4096
BLOOM_BITS = 24
MOST_MATCHES = 8
LONG_LIST = 30
#: Nodes and shingles of a block of a component, on average.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1 << 18
COLUMNS = 4096
#: A shingle compared in verification costs about this share of a prefix-list entry.
COMPARE_COST = 1 / 16


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    one = mix(tokens ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    two = mix(tokens + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row per document with size and signature of its set, and the sketch's counts as rows of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        table, names = space_table(), ["doc_id", "key", "n", "s1", "s2", "chunk", "counts"]
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(texts_of(batch.column("text")), width, table)
                np.add.at(counts, _bucket(np.concatenate(sets)), 1)
                marks = [_signature(s) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1))]
                none = [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns, *none], names)
        if counts.any():
            blocks = counts.reshape(-1, CHUNK)
            none = pa.nulls(len(blocks), pa.int64())
            packed = pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in blocks], pa.binary())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(blocks), pa.binary()), none, none, none, pa.array(range(len(blocks)), pa.int64()), packed], names)

    return map_arrow(_keyed(docs), work, "doc_id long, key binary, n long, s1 long, s2 long, chunk long, counts binary")


def summed_sketch(rows: DataFrame) -> np.ndarray:
    """The counts of all tasks, summed by chunk in two steps so that no group follows their number."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in part["counts"])
        return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    chunks = rows.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("lane"))
    part = chunks.groupBy("chunk", "lane").applyInPandas(add, "chunk long, counts binary")
    found = part.groupBy("chunk").applyInPandas(add, "chunk long, counts binary").collect()  # 256 rows at most
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in found:
        sketch[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return sketch


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``; the key names the text as it is, null counting as empty."""
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))


def prefixes(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Per document with shingles: size, signature and the longest prefix it may ask for, rare shingles first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = space_table()
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for place, tokens in enumerate(shingle_sets(texts_of(batch.column("text")), width, table)):
                    if len(tokens):
                        length = len(tokens) + min(0, MOST_MATCHES - _least(len(tokens), percent))
                        order = np.lexsort((tokens, sketch[_bucket(tokens)]))[:length]
                        rows.append((place, len(tokens), *_signature(tokens), tokens[order].view(np.int64)))
                chosen = batch.take(pa.array([r[0] for r in rows], pa.int64()))
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
                lists = pa.array([r[4] for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([chosen.column("doc_id"), chosen.column("key"), *numbers, lists], ["doc_id", "key", "n", "s1", "s2", "tokens"])

    found = map_arrow(_keyed(docs), work, "doc_id long, key binary, n long, s1 long, s2 long, tokens array<long>")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("rep")
    same = found.groupBy("s1", "s2").agg(first, *[F.first(c).alias(c) for c in ("n", "tokens")])
    return same.select(
        F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.key").alias("key"),
        "n", "tokens",
    )


def _least(size: int, percent: int) -> int:
    """The shingles a set of this size must share with any partner."""
    return -(-percent * size // 100)


def with_matches(lists: DataFrame, percent: int) -> DataFrame:
    """Adds ``matches``, the k that each document asks for.

    Every candidate lies in at least k of the prefix's lists, so there are at most (their summed
    length) / k candidates; each costs a comparison of sets on top of reading the lists.
    """
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    entries = [F.sum(F.when(F.col("pos") < F.col("n") - least + k, F.col("df")).otherwise(0)).alias(f"e{k}") for k in range(1, MOST_MATCHES + 1)]
    summed = lists.groupBy("node", "n").agg(*entries)
    cost = [F.col(f"e{k}") * (1 + F.col("n") * COMPARE_COST / k) for k in range(1, MOST_MATCHES + 1)]
    options = [F.when(least >= k, F.struct(c.alias("cost"), F.lit(k).alias("k"))) for k, c in enumerate(cost, 1)]
    picked = summed.select(F.col("node").alias("of"), F.array_min(F.array(*options))["k"].alias("matches"))
    return lists.join(picked, F.col("node") == F.col("of")).drop("of")


def meeting(met: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose first shared entry leaves room for the similarity.

    A pair of sizes m and n needs an overlap of o; so the first shingle both hold is among the
    first m - o + 1 of the one and n - o + 1 of the other.  Other entries bring no pairs.
    """
    overlap = F.ceil(F.lit(percent) * (F.col("an") + F.col("bn")) / (100 + percent))
    room = (F.col("ap") <= F.col("an") - overlap) & (F.col("bp") <= F.col("bn") - overlap)
    return met.where(room).select("a", "b").distinct()


def candidates(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """The pairs that share enough of their prefixes.

    All common shingles up to the last shared one lie in both prefixes, so the overlap is at most
    the hits and what follows that one in the shorter rest.
    """
    sides = [prefix.select(F.col("node").alias(x), *[F.col(c).alias(x + c) for c in ("n", "matches", "tokens")]) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.array_intersect("atokens", "btokens"))
    both = both.where(F.size("common") >= F.least("amatches", "bmatches"))
    last = F.element_at("common", -1)
    rest = F.least(*[F.col(f"{x}n") - F.array_position(f"{x}tokens", last) for x in "ab"])
    enough = (100 + percent) * (F.size("common") + rest) >= percent * (F.col("an") + F.col("bn"))
    return both.where(enough).select("a", "b")


def _bits(keys: list[bytes]) -> np.ndarray:
    """The two bits of each text key in the filter."""
    words = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)
    return (words[:, :2] >> np.uint32(32 - BLOOM_BITS)).astype(np.int64)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, tokens`` (sorted 64-bit hashes as bytes) for the given nodes, from their first document.

    A bit filter of fixed size over the wanted texts keeps most others out before the shuffle; the
    join that follows is exact, so the filter's size never changes the result.
    """
    spread = F.explode(F.array(*[F.substring(F.hex("key"), a, 8) for a in (1, 9)])).alias("part")
    bit = F.concat(*[F.substring("part", a, 2) for a in (7, 5, 3, 1)])  # little-endian, as the workers read it
    bit = F.shiftright(F.conv(bit, 16, 10).cast("long"), 32 - BLOOM_BITS)
    words = nodes.select(spread).select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas()  # 2**18 rows at most
    held = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    held[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    held = np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)
    packed = np.packbits(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = space_table(), np.unpackbits(packed).astype(bool)
        for whole in batches:
            hit = wanted[_bits(whole.column("key").to_pylist())].all(axis=1) if whole.num_rows else []
            for batch in pieces(whole.filter(pa.array(hit, pa.bool_())), "text"):
                sets = shingle_sets(texts_of(batch.column("text")), width, table)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "key", "tokens"])

    found = map_arrow(_keyed(docs), work, "doc_id long, key binary, tokens binary")
    exact = nodes.select("node", F.col("doc_id").alias("of"), F.col("key").alias("of_key"))
    joined = found.join(exact.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
    return joined.select("node", "tokens").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the similarity."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(100 * both >= percent * (len(one) + len(two) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """The linked ones of the candidate pairs."""
    pairs = written(pairs, f"{folder}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(nodes.select("node", "doc_id", "key").join(wanted, "node", "left_semi"), f"{folder}-nodes")
    return verified(pairs, written(full_sets(docs, wanted, width), f"{folder}-sets"), percent)


def _linked(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of the one list reach the similarity with which of the other, or of the same one if there is none."""
    sides = [one] if two is None else [one, two]
    sizes = [np.array([len(x) for x in side], np.int64) for side in sides]
    names, place = np.unique(np.concatenate([x for side in sides for x in side]), return_inverse=True)
    places = np.split(place, [sizes[0].sum()])[: len(sides)]
    held = [np.bincount(p, minlength=len(names)) for p in places]
    met = held[0] > 1 if two is None else (held[0] > 0) & (held[1] > 0)
    column = np.where(met, np.cumsum(met) - 1, -1)
    entries = []
    for p, size in zip(places, sizes, strict=True):
        col, row = column[p], np.repeat(np.arange(len(size)), size)
        order = np.argsort(col, kind="stable")
        entries.append((col[order], row[order]))
    both = np.zeros((len(sizes[0]), len(sizes[-1])))
    for at in range(0, int(met.sum()), COLUMNS):
        parts = []
        for (col, row), size in zip(entries, sizes, strict=True):
            a, b = np.searchsorted(col, [at, at + COLUMNS])
            parts.append(np.zeros((len(size), min(COLUMNS, int(met.sum()) - at)), np.float32))
            parts[-1][row[a:b], col[a:b] - at] = 1
        both += parts[0] @ parts[-1].T
    out = 100 * both >= percent * (sizes[0][:, None] + sizes[-1][None, :] - both)
    if two is None:
        np.fill_diagonal(out, False)
    return out


def partners(labels: DataFrame, weights: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """``node, partners``: the rows of all other nodes that each node with a link is similar to.

    ``weights`` has ``node, n, rows``.  Components of one block share groups, the others have a
    group for each pair of their blocks.
    """
    placed = written(labels.join(weights.hint("merge"), "node"), f"{folder}/members")
    sizes = placed.groupBy("comp").agg(F.sum("n").alias("shingles"), F.count("*").alias("members"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_NODES))
    sizes = written(sizes.select("comp", "shingles", blocks.alias("blocks")), f"{folder}/blocks")
    lanes = (sizes.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0) // BLOCK_SHINGLES + 1
    placed = placed.join(sizes.drop("shingles").hint("merge"), "comp")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    held = written(placed.join(sets.hint("merge"), "node"), f"{folder}/held")
    lane = F.pmod(F.xxhash64("comp", F.lit("lane")), F.lit(lanes))
    few = held.where("blocks = 1").select(lane.alias("home"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), "comp", "block", "node", "rows", "tokens")
    many = held.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select(F.col("comp").alias("home"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "comp", "block", "node", "rows", "tokens")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
        tokens = [np.frombuffer(x, np.uint64) for x in part["tokens"]]
        nodes, rows, found = part["node"].to_numpy(), part["rows"].to_numpy(), np.zeros(len(part), np.int64)
        if low == high:
            comp = part["comp"].to_numpy()
            order = np.argsort(comp, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
                found[at] = _linked([tokens[k] for k in at], None, percent) @ rows[at]
        else:
            block = part["block"].to_numpy()
            one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if len(one) and len(two):
                alike = _linked([tokens[k] for k in one], [tokens[k] for k in two], percent)
                found[one], found[two] = alike @ rows[two], alike.T @ rows[one]
        return pd.DataFrame({"node": nodes, "found": found})

    counted = few.unionByName(many).groupBy("home", "low", "high").applyInPandas(count, "node long, found long")
    return counted.groupBy("node").agg(F.sum("found").alias("partners"))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, counted: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, links``, and ``comp, key`` (component and text).

    ``links`` counts all other rows whose shingles reach the similarity with the row's, equal ones
    among them; without ``counted`` it is null.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "jaccard")
    rows = written(signatures(docs, width), f"{folder}/rows")
    nodes = written(prefixes(docs, width, percent, summed_sketch(rows)), f"{folder}/nodes")
    entries = nodes.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = written(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), f"{folder}/shared")
    lists = written(entries.join(shared.hint("merge"), "token"), f"{folder}/shared-lists")
    lists = written(with_matches(lists, percent), f"{folder}/lists")

    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    asked = lists.select("node", "matches").distinct()
    prefix = nodes.join(asked, "node").withColumn("tokens", F.slice("tokens", F.lit(1), (F.col("n") - least + F.col("matches")).cast("int")))
    prefix = written(prefix.select("node", "n", "matches", "tokens"), f"{folder}/prefix")
    lists = written(lists.where(F.col("pos") <= F.col("n") - least), f"{folder}/first-entries")

    long = lists.where(F.col("df") >= LONG_LIST)
    weight = long.groupBy("node").agg(F.sum("df").alias("weight"))
    pivot = long.join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node", "n", "pos")).alias("p"))
    pivot = pivot.select(F.col("token").alias("t"), F.col("p.node").alias("a"), F.col("p.n").alias("an"), F.col("p.pos").alias("ap"))
    met = long.join(written(pivot, f"{folder}/pivots").hint("merge"), F.col("token") == F.col("t")).where("node != a")
    met = met.select("a", "an", "ap", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    pairs = candidates(meeting(met, percent), prefix, percent)
    first = written(_compared(docs, nodes, pairs, width, percent, f"{folder}/star"), f"{folder}/first")
    labels = components(first, f"{folder}/one")

    placed = written(lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), f"{folder}/placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select(F.col("token").alias("t"))
    open_lists = placed.join(written(mixed, f"{folder}/mixed").hint("merge"), F.col("token") == F.col("t"), "left_semi")
    open_lists = written(open_lists, f"{folder}/open")
    one, two = (
        open_lists.select("token", *[F.col(c).alias(x + d) for c, d in (("node", ""), ("n", "n"), ("pos", "p"), ("comp", "c"))]) for x in "ab"
    )
    met = one.join(two, "token").where((F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")))
    pairs = candidates(meeting(met, percent), prefix, percent)
    second = written(_compared(docs, nodes, pairs, width, percent, f"{folder}/rest"), f"{folder}/second")
    links = written(first.union(second), f"{folder}/links")
    labels = components(links, f"{folder}/two")

    named = nodes.select("node", "s1", "s2", "n", "doc_id").join(labels, "node", "left").withColumn("links", F.lit(None).cast("long"))
    if counted:
        copies = rows.where("n > 0").groupBy("s1", "s2").agg(F.count("*").alias("rows"))
        weights = written(nodes.select("node", "s1", "s2", "n").join(copies.hint("merge"), ["s1", "s2"]), f"{folder}/weights")
        sets = spark.read.schema("node long, tokens binary").parquet(f"{folder}/star-sets", f"{folder}/rest-sets").dropDuplicates(["node"])
        weights = weights.select("node", "n", "rows")
        met = written(partners(labels, weights, sets, percent, folder), f"{folder}/partners")
        total = weights.join(met, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("partners", F.lit(0))).alias("links"))
        named = named.drop("links").join(total, "node")
    named = named.drop("n")
    named = written(named.withColumn("comp", F.coalesce("comp", "node")), f"{folder}/named")
    smallest = written(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), f"{folder}/smallest")
    named = written(named.join(smallest.hint("merge"), "comp").drop("doc_id"), f"{folder}/components")
    plain = rows.where("chunk IS NULL").withColumnRenamed("n", "n_shingles")
    found = plain.where("n_shingles > 0").join(named.hint("merge"), ["s1", "s2"])
    found = found.select("doc_id", "n_shingles", "component_id", "links", "comp", "key")
    alone = plain.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0 if counted else None).cast("long").alias("links"), F.lit(None).cast("long").alias("comp"), "key"
    )
    return found.unionByName(alone)


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest ``doc_id``, and all rows without shingles."""
    folder = run_folder(docs.sparkSession, "jaccard")
    placed = written(groups(docs, width, percent, counted=False), f"{folder}/groups")
    alike = placed.where("comp IS NOT NULL").groupBy("comp", "doc_id", "key").agg(F.count("*").alias("n"))
    best = alike.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("b"))
    best = best.select(F.struct("comp").alias("of"), F.col("b.doc_id").alias("best_id"), F.col("b.key").alias("best_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key"))
    marks = alike.join(best.hint("merge"), F.struct("comp") == F.col("of"))
    marks = marks.select(F.col("doc_id").alias("id"), "key", F.when(stays, 1).otherwise(0).alias("stay"), "n").where("stay = 0 OR n > 1")
    return decided(docs, written(marks.select("id", "key", "stay"), f"{folder}/marks"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")
