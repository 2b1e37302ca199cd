"""Order-dependent folds per key without gathering a hot key in one task.

A fold over the ordered events of a key (suppression, a lockout counter) looks
sequential.  Keys with few rows are folded in the JVM over one short sorted
array.  For a hot key the time line is cut into fixed chunks: each chunk is
summarised, in parallel, into a small table "state on entry -> state on exit".
Summaries of neighbouring chunks are composed in rounds, ``FAN`` at most in one
task, until one task per key can chain the last ``FAN`` of them; then entry
states are handed down the same tree, and finally every chunk is replayed, in
parallel, from its exact entry state.  A key that holds a third of all rows is
spread over all its chunks, no task reads more than ``FAN`` summaries, and the
result is the same as that of a single pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys above this many rows take the chunked route, in chunks of about this many rows.
HOT_ROWS = 2000
CHUNK_ROWS = 50_000
# Summaries that one task composes or chains, as a power of two.
FAN_BITS = 8
# Times are below 2**53 microseconds (the year 2255) either side of 1970.
TIME_BITS = 53


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


@dataclass(frozen=True)
class Fold:
    """One fold in its two forms; both give the times (microseconds) it emits.

    native(sorted array of row structs) -> array of emitted times
    summarise(chunk rows, chunk start)  -> summary
    compose(summary, next summary)      -> summary of both
    advance(summary, entry state)       -> exit state
    replay(chunk rows, entry state)     -> emitted times
    encode / decode                     -> state to text and back
    """

    native: Callable[[Column], Column]
    summarise: Callable[[pd.DataFrame, int], bytes]
    compose: Callable[[bytes, bytes], bytes]
    advance: Callable[[bytes, Any], Any]
    replay: Callable[[pd.DataFrame, Any], list]
    initial: Any
    encode: Callable[[Any], str]
    decode: Callable[[str], Any]


def fold_by_key(
    rows: DataFrame,
    key: str,
    fold: Fold,
    slot_micros: int,
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Emitted (key, t) rows of a fold over ``rows`` (key, t, ...) in order of t.

    ``hot_rows`` None is for callers that know no key to be hot: all are folded in the JVM.

    ``rows`` must be distinct by (key, t).  Rows are counted per key and time
    slot first; a hot key's chunks are one slot wide where its slots are full
    and as many slots as hold about ``chunk_rows`` rows where they are not.
    """
    rest = [c for c in rows.columns if c not in (key, "t")]

    def folded(part: DataFrame) -> DataFrame:
        lists = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", *rest))).alias("_rows"))
        return lists.select(key, F.explode(fold.native(F.col("_rows"))).alias("t"))

    if hot_rows is None:
        return folded(rows)
    slots = rows.groupBy(key, F.floor(F.col("t") / F.lit(slot_micros)).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    slots_per_chunk = F.greatest(F.lit(1), F.floor(F.lit(chunk_rows) * F.col("_slots") / F.col("_n")))
    hot = (
        slots.groupBy(key)
        .agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_slots"))
        .filter(F.col("_n") > hot_rows)
        .select(key, (slots_per_chunk * F.lit(slot_micros)).cast("bigint").alias("_width"))
    )
    short = folded(rows.join(hot.select(key), key, "left_anti"))
    return short.unionByName(_chunked(rows.join(hot, key), key, fold, slot_micros))


def levels(slot_micros: int) -> int:
    """Rounds after which at most ``2**FAN_BITS`` nodes of a key are left, whatever its chunks."""
    bits = TIME_BITS + 1 - (max(1, slot_micros).bit_length() - 1)
    return max(1, -(-bits // FAN_BITS)) - 1


def _few(nodes: pd.DataFrame) -> pd.DataFrame:
    if len(nodes) > 1 << FAN_BITS:
        raise ValueError(f"{len(nodes)} summaries in one task; at most {1 << FAN_BITS} are expected")
    return nodes.sort_values("_node")


def entry_states(summaries: DataFrame, key: str, fold: Fold, rounds: int) -> DataFrame:
    """``key, _node, _entry``: the state before each chunk, from ``key, _node, summary``.

    Nodes are numbered by chunk; the parent of a node is its number without the last ``FAN_BITS``
    bits, so a round needs no ranking of a key's chunks.
    """
    kind = summaries.schema[key].dataType.simpleString()

    def composed(keys, pdf):
        held = _few(pdf)["summary"].tolist()
        whole = held[0]
        for part in held[1:]:
            whole = fold.compose(whole, part)
        return pd.DataFrame({key: [keys[0]], "_node": [keys[1]], "summary": [whole]})

    def chained(pdf, key_value, state):
        nodes, entries = _few(pdf), []
        for summary in nodes["summary"]:
            entries.append(fold.encode(state))
            state = fold.advance(summary, state)
        return pd.DataFrame({key: key_value, "_node": nodes["_node"].to_numpy(), "_entry": entries})

    parent = F.shiftright("_node", FAN_BITS).alias("_up")
    tree = [summaries]
    for _ in range(rounds):
        tree.append(
            tree[-1].groupBy(key, parent).applyInPandas(composed, f"`{key}` {kind}, _node bigint, summary binary")
        )
    found = tree[-1].groupBy(key).applyInPandas(
        lambda keys, pdf: chained(pdf, keys[0], fold.initial), f"`{key}` {kind}, _node bigint, _entry string"
    )
    for nodes in reversed(tree[:-1]):

        def handed_down(keys, children, above):
            if not len(children):
                return pd.DataFrame({key: [], "_node": [], "_entry": []})
            return chained(children, keys[0], fold.decode(above["_entry"].iloc[0]))

        found = (
            nodes.groupBy(key, parent)
            .cogroup(found.groupBy(key, F.col("_node").alias("_up")))
            .applyInPandas(handed_down, f"`{key}` {kind}, _node bigint, _entry string")
        )
    return found


def _chunked(rows: DataFrame, key: str, fold: Fold, slot_micros: int) -> DataFrame:
    cut = rows.withColumn("_node", F.floor(F.col("t") / F.col("_width")).cast("bigint"))
    kind = rows.schema[key].dataType.simpleString()

    def summary_of(keys, pdf):
        made = fold.summarise(pdf.sort_values("t"), int(keys[1]) * int(pdf["_width"].iloc[0]))
        return pd.DataFrame({key: [keys[0]], "_node": [keys[1]], "summary": [made]})

    def replay_chunk(keys, pdf, entry):
        times = fold.replay(pdf.sort_values("t"), fold.decode(entry["_entry"].iloc[0])) if len(pdf) else []
        # Shaped from the input rows, so that column types survive empty results.
        return pdf[[key, "t"]].iloc[: len(times)].assign(t=np.asarray(times, dtype="int64"))

    summaries = cut.groupBy(key, "_node").applyInPandas(summary_of, f"`{key}` {kind}, _node bigint, summary binary")
    entries = entry_states(summaries, key, fold, levels(slot_micros))
    return (
        cut.groupBy(key, "_node")
        .cogroup(entries.groupBy(key, "_node"))
        .applyInPandas(replay_chunk, f"`{key}` {kind}, t bigint")
    )
