"""Parquet, CSV and file-listing sources of tickets, directory and endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightdesk import schemas


def read_ticket_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TICKET_TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")


def read_ticket_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All service-desk tables under one folder."""
    return {name: read_ticket_table(spark, folder, name) for name in schemas.TICKET_TABLES}


def read_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Directory snapshot: units, groups, users and policies."""
    parts = {"ou": schemas.AD_OU, "group": schemas.AD_GROUP, "user": schemas.AD_USER, "gpo": schemas.GPO}
    return {
        name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
        for name, schema in parts.items()
    }


def read_admin_accounts(spark: SparkSession, path: str) -> DataFrame:
    """CSV lookup ``username,is_admin``."""
    return spark.read.schema(schemas.ADMIN_ACCOUNTS).csv(path, header=True)


def read_app_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.APP_EVENT).json(path)


def read_hotfixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HOTFIX).json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File listing (path, length, last_write); contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("path", "length", F.col("modificationTime").alias("last_write"))


def require_table(spark: SparkSession, name: str) -> None:
    """Fail early when a table the load depends on is missing."""
    if not spark.catalog.tableExists(name):
        raise RuntimeError(f"table {name} does not exist; create the service-desk tables first")
