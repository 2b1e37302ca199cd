"""URL allow and block rules by a sorted sweep over reversed-host keys.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the rule's.
Written as reversed host labels and path, ``org,example)/es/``, a rule is an interval of keys:
everything that starts with it.  A URL has one key per ending of its host, cut to the longest
host among the rules.  Rules and keys are sorted together; the sweep carries the stack of rules
nested around the last one passed, and a key takes the innermost of them that it starts with.
Over the endings of one URL the longest rule wins, then the longer host.

The sweep runs per rule host.  A host that holds many URLs is dealt over salts, each with all rules
of that host, so that no part holds more than a thousandth of all keys or a million of them.

Null URLs and URLs without ``://`` have empty host and path and match nothing; what no rule fits
gets the default verdict.  Of rules with equal host and path, block wins.  Repeated URLs are judged
once and joined back; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from nightdesk.llm.registry import query, table
from nightdesk.llm.store import run_folder, written

PART_SHARE, PART_ROWS = 1000, 1_000_000
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 3), F.lit(""))


def _key(host, path):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``ending, key, stack``: each rule with itself and the rules around it, from short to long."""
    clean = rules.where("host <> '' AND path IS NOT NULL").groupBy(F.translate("host", UPPER, LOWER).alias("ending"), "path")
    clean = clean.agg(F.max("verdict").alias("verdict")).withColumn("key", _key(F.col("ending"), F.col("path")))
    around = clean.select("ending", F.col("key").alias("inner"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    entry = F.struct(F.length("key").alias("size"), "key", F.concat("ending", "path").alias("rule"), "verdict")
    nested = around.join(clean, ["ending", "path"]).groupBy("ending", "inner").agg(F.array_sort(F.collect_list(entry)).alias("stack"))
    return nested.select("ending", F.col("inner").alias("key"), "stack")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` for the distinct URLs that a rule fits."""
    spark = urls.sparkSession
    folder = run_folder(spark, "rules")
    stacks = written(rule_stacks(rules), f"{folder}/stacks")
    deepest = stacks.agg(F.max(F.size(F.split("ending", r"\.", -1)))).first()[0] or 0
    known = urls.where("url IS NOT NULL").groupBy("url").agg(F.lit(1).alias("one"))
    known = known.select("url", F.split(host_of(F.col("url")), r"\.", -1).alias("labels"), path_of(F.col("url")).alias("path"))
    endings = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, deepest)))), lambda n: F.array_join(F.slice("labels", -n, n), ".")
    )
    keys = known.where("labels[0] <> '' OR size(labels) > 1").select("url", "path", F.explode(endings).alias("ending"))
    held = keys.groupBy("ending").agg(F.count("*").alias("n"))
    hosts = written(held.join(stacks.select("ending").distinct(), "ending", "left_semi"), f"{folder}/hosts")
    total = F.lit(hosts.agg(F.sum("n")).first()[0] or 1)
    parts = F.greatest(F.ceil(F.col("n") * PART_SHARE / total), F.ceil(F.col("n") / PART_ROWS)).cast("int")
    parts = written(hosts.select("ending", parts.alias("parts")), f"{folder}/parts")  # a row per rule host

    salt = F.pmod(F.xxhash64("url"), F.col("parts")).cast("int")
    probes = keys.join(parts, "ending").select(
        "ending", salt.alias("salt"), _key(F.col("ending"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "url"
    )
    bounds = stacks.join(parts, "ending").select(
        "ending", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "key", F.lit(0).alias("kind"), "stack"
    )
    swept = probes.unionByName(bounds, allowMissingColumns=True)
    order = Window.partitionBy("ending", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    inner = F.expr("filter(stack, x -> startswith(key, x.key))")
    hits = swept.select("url", "ending", inner.alias("fits")).where("size(fits) > 0").select("url", "ending", F.element_at("fits", -1).alias("top"))
    rank = F.struct(F.length(F.col("top.rule")).alias("size"), F.length("ending").alias("host"), F.col("top.rule"), F.col("top.verdict"))
    best = hits.groupBy("url").agg(F.max(rank).alias("b")).select("url", "b.rule", "b.verdict")
    return written(best, f"{folder}/best")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` with ``nd_host``, ``nd_path``, ``nd_rule`` and ``nd_verdict``.

    Columns of these names are replaced.
    """
    pages = pages.drop("nd_host", "nd_path", "nd_rule", "nd_verdict", "nd_url")
    best = matched(pages.select(F.col("url").cast("string").alias("url")), rules)
    best = best.select(F.col("url").alias("nd_url"), F.col("rule").alias("nd_rule"), F.col("verdict").alias("nd_verdict"))
    joined = pages.join(best.hint("merge"), F.col("url") == F.col("nd_url"), "left").drop("nd_url")
    return joined.withColumns({
        "nd_host": host_of(F.col("url")), "nd_path": path_of(F.col("url")), "nd_verdict": F.coalesce("nd_verdict", F.lit(default)),
    })


@query(
    "op7_url_rules",
    r"""
WITH r(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), m AS (
  SELECT u.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *[F.col(f"nd_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])
