"""Stored tables that are changed by key: upsert and delete with touched buckets rewritten only.

A table is a folder of versions.  Every version has a commit record: one JSON line per bucket that
names the folder of the bucket's rows.  A change reads the buckets its keys fall in, writes their new
rows to folders of its own, and then writes the record of the next version; buckets it does not touch
are named again, not copied.  A version is there when its record is; a run that dies before leaves
the version before it, and its folders are not named by anything.  A change that alters no row writes
no version.  One writer at a time: a record that is there already is never replaced.

Keys are whole rows of the key columns; nulls are keys of their own and never meet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk.functions.scalars import first_per_key
from nightdesk.sources.sinks import keep_unless

BUCKETS = 32


class KeyedTable:
    """The table at ``path``; its key and number of buckets are fixed with its first version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets

    # --- versions ------------------------------------------------------------------------------

    def _fs(self):
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        return base.getFileSystem(self.spark._jsc.hadoopConfiguration()), base

    def versions(self) -> list[int]:
        """Numbers of the committed versions."""
        system, base = self._fs()
        if not system.exists(base):
            return []
        names = [f.getPath().getName() for f in system.listStatus(base)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _record(self, version: int) -> dict[int, str]:
        """Folder per bucket; a record has one line per bucket at most."""
        lines = self.spark.read.text(f"{self.path}/_versions/{version:09d}.json").collect()
        return {entry["bucket"]: entry["folder"] for entry in (json.loads(r["value"]) for r in lines)}

    def _commit(self, version: int, record: dict[int, str]) -> None:
        """Write the record aside and give it its name at once."""
        system, base = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        aside, final = path(base, f".{uuid.uuid4().hex}"), path(base, f"{version:09d}.json")
        system.mkdirs(base)
        text = "".join(json.dumps({"bucket": b, "folder": f}) + "\n" for b, f in sorted(record.items()))
        out = system.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if system.exists(final) or not system.rename(aside, final):
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")

    # --- rows ----------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest or of an older version."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self._rows(self._record(known[-1] if version is None else version).values())

    def _rows(self, folders) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _same(self, a: str, b: str) -> Column:
        """Rows with equal keys, none of them null."""
        out = F.lit(True)
        for c in self.key:
            out &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
        return out

    def upsert(self, rows: DataFrame, overwrite: bool = True) -> int:
        """Add rows whose key is new and, with ``overwrite``, replace those whose key is there; returns the version.

        Of several new rows with one key the smallest counts.  Without ``overwrite`` what is stored stays.
        """
        names = self.spark.createDataFrame([], self.schema).columns
        new = first_per_key(rows.select(*names), self.key)

        def change(old: DataFrame, fresh: DataFrame) -> DataFrame:
            if overwrite:
                kept = old.alias("o").join(fresh.alias("n"), self._same("o", "n"), "left_anti")
                return kept.unionByName(fresh)
            return old.unionByName(fresh.alias("n").join(old.alias("o"), self._same("n", "o"), "left_anti"))

        return self._changed(new.withColumn("_bucket", self._bucket()), change)

    def delete(self, where: Column) -> int:
        """Remove the rows a predicate names; rows where it is unknown stay.  Returns the version."""
        hit = self.read().filter(F.coalesce(where, F.lit(False))).withColumn("_bucket", self._bucket())
        return self._changed(hit, lambda old, _: keep_unless(old, where))

    def _changed(self, touching: DataFrame, change) -> int:
        """Rewrite the buckets that hold rows of ``touching`` and commit the next version."""
        known = self.versions()
        current, record = (known[-1], self._record(known[-1])) if known else (0, {})
        run = uuid.uuid4().hex
        staged = f"{self.path}/_staged/{run}"
        touching.write.partitionBy("_bucket").parquet(staged)  # so that rows and buckets are fixed
        system, _ = self._fs()
        listed = system.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(staged))
        buckets = sorted(int(n.split("=")[1]) for n in (f.getPath().getName() for f in listed) if n.startswith("_bucket="))
        if not buckets:
            return current
        fresh = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(staged).drop("_bucket")
        old = self._rows({record[b] for b in buckets if b in record})
        after = change(old, fresh)
        whole = after.withColumn("_bucket", self._bucket())
        whole = whole.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.key)
        whole.write.partitionBy("_bucket").parquet(f"{self.path}/data-{run}")
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/data-{run}").drop("_bucket")
        if written.exceptAll(old).isEmpty() and old.exceptAll(written).isEmpty():
            return current
        names = [f.getPath().getName() for f in system.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data-{run}"))]
        now = {int(n.split("=")[1]): f"data-{run}/{n}" for n in names if n.startswith("_bucket=")}
        self._commit(current + 1, {b: f for b, f in record.items() if b not in buckets} | now)
        return current + 1
