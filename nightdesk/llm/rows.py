"""Whole rows carried through an operator out of reach of its own column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "nd_row"


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """``nd_row`` (all columns but the text), ``text`` and the given columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(F.lit(True).alias("nd_one"), *rest).alias(ROW), "text", *more)


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The original columns again."""
    return rows.select(*[F.col("text") if c == "text" else F.col(ROW)[c].alias(c) for c in columns])


#: Bits of the filter that keeps rows out of a shuffle; a join follows, so its size changes no result.
FILTER_BITS = 25


def text_key() -> Column:
    """Names a text as it is, null counting as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def split_by(rows: DataFrame, name: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``name`` may be among ``keys`` (one column), and those where it is not.

    A bit filter of fixed size over the keys is broadcast, 2**19 rows at most; it errs on one side only.
    """

    def bit(c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)

    words = keys.select(bit(F.col(keys.columns[0])).alias("bit")).groupBy(F.shiftright("bit", 6).alias("nd_word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("nd_bits"))
    asked = rows.withColumn("nd_bit", bit(name)).join(F.broadcast(words), F.shiftright("nd_bit", 6) == F.col("nd_word"), "left")
    may = F.coalesce(F.expr("(shiftrightunsigned(nd_bits, CAST(nd_bit & 63 AS INT)) & 1) = 1"), F.lit(False))
    return asked.where(may).select(rows.columns), asked.where(~may).select(rows.columns)


def decided(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``marks`` has ``id, key, stay`` per identity (``doc_id`` and :func:`text_key`) that does not
    simply stay: of its rows none (``stay`` 0) or one (``stay`` 1) is kept.  Rows of other identities
    stay.  A bit filter over the marks lets most rows pass without a shuffle; only the rest meets the
    marks, and one identity with many rows is split by adaptive execution.
    """
    rows = wrapped(docs, F.col("doc_id").cast("long").alias("nd_id"), text_key().alias("nd_key"))
    asked, passed = split_by(rows, F.struct("nd_id", "nd_key"), marks.select(F.struct("id", "key").alias("both")))
    exact = marks.select(F.col("id").alias("nd_mark"), F.col("key").alias("nd_mark_key"), F.col("stay").alias("nd_stay"))
    same = F.col("nd_id").eqNullSafe(F.col("nd_mark")) & (F.col("nd_key") == F.col("nd_mark_key"))
    met = asked.join(exact.hint("merge"), same, "left")
    once = met.where("nd_stay = 1").select(rows.columns).dropDuplicates(["nd_id", "nd_key"])
    out = passed.unionByName(met.where("nd_stay IS NULL").select(rows.columns)).unionByName(once)
    return unwrapped(out, docs.columns)
