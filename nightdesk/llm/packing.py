"""Packing documents into token sequences: first-fit decreasing within random groups.

A document is its token ids and a closing id.  Runs of a whole sequence length stand alone; the
rest of each document is dealt into random groups of bounded size, and each group is packed by
first-fit decreasing, where a tournament tree over the free space of the bins finds the first
bin that fits in logarithmic time.  Groups are packed independently.

Null texts count as empty, so such a document is its closing id.  Repeated rows are separate
documents, also when their ``doc_id`` is the same or null.  An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written
from nightdesk.llm.text import map_arrow, pieces, texts_of

SEQUENCE = 4096
END_ID = 2
GROUP_ROWS = 2000
CACHE_WORDS = 700_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def worker_memo(name: str) -> dict:
    """A dictionary that outlives the task, as long as Spark keeps the Python worker."""
    return vars(sys.modules.setdefault("nightdesk_worker_memo", types.ModuleType("nightdesk_worker_memo"))).setdefault(name, {})


class WordEncoder(dict):
    """Token ids (little-endian unsigned 32-bit) of each distinct word, found once.

    Right for tokenizers that never join characters across ASCII white space, as the word-based
    one here: a text's ids are then those of its words in turn.  Plain Latin letters skip the
    normaliser, which only lower-cases them, and go to the merges directly.  Emptied when full.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.cores: dict[str, bytes] = {}
        # A word, its bytes as the letters that stand for them in the vocabulary, closing marks apart.
        self.plain = re.compile("([a-zà-öø-ÿ]+)([.,;:!?]*)").fullmatch
        self.letters = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
        self.letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.letters)}
        self.by_word = "Split" in str(self.tokenizer.pre_tokenizer) and "Lowercase" in str(self.tokenizer.normalizer)
        if any(self._whole(f"b{gap}c") != self._whole("b") + self._whole("c") for gap in (" ", "  ", "\n", "\t")):
            raise ValueError(f"{path} joins characters across white space; texts cannot be encoded word by word")

    def _core(self, word: str) -> bytes:
        ids = self.cores.get(word)
        if ids is None:
            spelled = word.encode().decode("latin-1").translate(self.letters)
            ids = self.cores[word] = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        found = self.plain(text.lower()) if self.by_word else None
        if found is None:
            ids = self._whole(text)
        else:
            ids = self._core(found[1])
            if found[2]:
                if found[2] not in self.cores:
                    self.cores[found[2]] = self._whole(found[2])
                ids += self.cores[found[2]]
        self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self) + len(self.cores) > self.cache_words:
            self.clear()
            self.cores.clear()
        return [b"".join([self[w] for w in t.split()]) for t in texts]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of at most ``sequence`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked, ``ids``."""
    closing = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo("encoders")
        known = (tokenizer, cache_words)
        encoder = memo[known] = memo.get(known) or WordEncoder(tokenizer, cache_words)
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = [[] for _ in range(6)]
                coded = encoder.encode(texts_of(batch.column("text")))
                for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                    ids += closing
                    total = len(ids) // 4
                    for at in range(0, total, sequence):
                        part = ids[4 * at : 4 * (at + sequence)]
                        for column, value in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), total, part), strict=True):
                            column.append(value)
                arrays = [pa.array(x, pa.int64()) for x in rows[:5]] + ([pa.array(rows[5], pa.binary())] if with_ids else [])
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(chosen, work, PIECE_SCHEMA + ", ids binary" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` must be sorted from long to short.

    The tree's leaves are bins in order of opening, each inner node holds the largest free space
    below it; walking left whenever the left half fits gives the first bin that fits.
    """
    leaves = 1 << max(1, int(len(lengths)) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack_pieces(cut: DataFrame, sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces.

    Whole sequences stay where they are and get odd ids; packed ones get even ids.  The group of
    a piece depends on its place in the table, so equal rows spread like any others.
    """
    rest = cut.where(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_rows))
    place = F.monotonically_increasing_id()
    whole = cut.where(F.col("length") == sequence).select(*cut.columns, (place * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = rest.withColumn("row", place).withColumn("group", F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(groups)))
    names = cut.columns

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), sequence)
        out = part[names].copy()
        out["sequence_id"] = ((part["group"].to_numpy() << 24) + bins) * 2
        out["offset"] = offsets
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return whole.unionByName(dealt.groupBy("group").applyInPandas(pack, kinds))


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their places in the sequences; a worker keeps up to ``cache_words`` encoded words."""
    cut = written(cut_pieces(docs, tokenizer, end_id, sequence, with_ids, cache_words), f"{run_folder(docs.sparkSession, 'packing')}/pieces")
    return pack_pieces(cut, sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the little-endian ids of each sequence, from pieces packed ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
