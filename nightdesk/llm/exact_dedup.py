"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  New rows are digested, reduced to one keeper
per digest, matched to the index by a sort-merge anti-join that needs no shuffle on the index
side, and appended.  A batch has a name and a fingerprint of its rows' identities: a run of the same
rows under the same name, however they are partitioned, finds its own digests, adds nothing and gives
the same result; other rows under a name that is taken are refused.

Two texts are equal when they are the same after the characters 20 and 09-0D are deleted; null
counts as empty.  The keeper is the row with the most code points, then the smallest ``doc_id``
(nulls last), then any one of the rows that repeat both (which have the same text but for white space).
Extra columns and their names play no part; an empty batch leaves the index as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.rows import decided, text_key
from nightdesk.llm.store import run_folder, written

BUCKETS = 64
DIGEST_SCHEMA = "digest BINARY, keep_id BIGINT, keep_chars INT, group_size BIGINT, batch STRING"
BATCH_SCHEMA = "batch STRING, mark STRING"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, chars, digest, key, row`` of every row; all other columns are left behind.

    ``key`` names the text as it is.  ``row`` tells rows apart within this run only and is never
    stored in the index.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        text_digest(F.col("text")).alias("digest"),
        text_key().alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def keepers(rows: DataFrame) -> DataFrame:
    """One row per digest: identity of the keeper, its row in this run, rows that repeat it, size of the group.

    Copies collapse before the shuffle, so a digest with a third of all rows costs little.
    """
    alike = rows.groupBy("digest", "chars", "doc_id", "key").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "key", "row", "n"))
    picked = alike.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("group_size"))
    return picked.select(
        "digest",
        F.col("b.doc_id").alias("keep_id"),
        (-F.col("b.col1")).cast("int").alias("keep_chars"),
        F.col("b.key").alias("keep_key"),
        F.col("b.row").alias("keep_row"),
        F.col("b.n").alias("ties"),
        "group_size",
    )


class DigestIndex:
    """The persistent index at ``path``; open it again in any later session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"nd_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:40]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({DIGEST_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_batches ({BATCH_SCHEMA}) USING parquet LOCATION '{self.path}-batches'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def claim(self, rows: DataFrame, batch: str) -> None:
        """Enter the batch name with a fingerprint of its rows; a name that other rows hold is refused.

        The fingerprint is a sum over rows, so it does not depend on their order or partitioning.  It
        is entered before any digest, so a run that dies in between is known when it comes again.
        """
        one = F.xxhash64("digest", "doc_id", "chars").cast("decimal(20,0)")
        mark = rows.agg(F.count("*").alias("n"), F.sum(one).cast("string").alias("total")).first()
        mark = f"{mark['n']}:{mark['total']}"
        held = {r["mark"] for r in self.spark.table(f"{self.name}_batches").where(F.col("batch") == batch).select("mark").distinct().take(2)}
        if held - {mark}:
            raise ValueError(f"the index holds other rows as batch {batch!r}; give these another name")
        if not held:
            self.spark.createDataFrame([(batch, mark)], BATCH_SCHEMA).write.insertInto(f"{self.name}_batches")

    def append(self, found: DataFrame, batch: str) -> None:
        """Add the keepers whose digest the index does not hold."""
        new = found.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        new.withColumn("batch", F.lit(batch)).select(*self.entries().columns).write.insertInto(self.name)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Index the digests ``rows``; per digest of this run the keeper in the index and the best row of this run.

        ``mine`` tells that the keeper is a row of this batch, then it is the best row of this run.  That
        row is found anew from the rows themselves, so nothing depends on how an earlier run was partitioned.
        """
        self.claim(rows, batch)
        found = keepers(rows)
        self.append(found, batch)
        index = self.entries().select("digest", F.col("keep_id").alias("of_id"), F.col("group_size").alias("of_size"), "batch")
        # Both are on digest already: the index by its buckets, the keepers by their aggregation.
        joined = found.join(index.hint("merge"), "digest")
        return joined.select(
            "digest", F.col("of_id").alias("keep_id"), "keep_key", "keep_row", "ties", F.col("of_size").alias("group_size"),
            (F.col("batch") == batch).alias("mine"),
        )


def exact_groups(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``; rows of earlier batches win.

    ``group_size`` counts the rows of the batch that brought the digest.  An index that stays needs a
    name for the batch.  The join key is the digest as text, so both sides get a shuffle of their own
    and adaptive execution can split a digest that holds much of the data.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "exact")
    rows = written(digests(docs), f"{folder}/digests")
    found = DigestIndex(spark, index_path or f"{folder}/index").add(rows, _named(index_path, batch))
    found = written(found.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "keep_row", "group_size", "mine"), f"{folder}/keepers")
    joined = rows.withColumn("text_sha256", F.lower(F.hex("digest"))).join(found.hint("merge"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("mine") & (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def _named(index_path: str | None, batch: str | None) -> str:
    if batch is None and index_path is not None:
        raise ValueError("a batch for an index that stays needs a name")
    return batch or "all"


def deduplicate(docs: DataFrame, index_path: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is decided on digests alone; texts that stay are not shuffled (see :func:`decided`).
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "exact")
    rows = written(digests(docs), f"{folder}/digests")
    found = DigestIndex(spark, index_path or f"{folder}/index").add(rows, _named(index_path, batch))
    best = found.select(F.struct("digest").alias("of"), "keep_id", "keep_key", "ties", "mine")
    alike = rows.select("digest", F.col("doc_id").alias("id"), "key").distinct()
    stays = F.col("mine") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    marks = alike.join(best.hint("merge"), F.struct("digest") == F.col("of"))
    marks = marks.select("id", "key", F.when(stays, 1).otherwise(0).alias("stay"), "ties").where("stay = 0 OR ties > 1")
    return decided(docs, written(marks.select("id", "key", "stay"), f"{folder}/marks"))


@query(
    "op8_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
