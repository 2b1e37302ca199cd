"""Directory memberships, inventories, group-change decisions and offboarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightdesk import vocab
from nightdesk.functions.scalars import contains_text, date_or, left_lookup, list_text
from nightdesk.functions.timerange import as_datetime


def memberships(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (sam, group) pairs from the users' group lists.

    Names compare without case and come back as the catalogue spells them.
    ``status`` is ``OK``, or ``WARN`` where the group is not in the catalogue.
    """
    pairs = users.select("sam", F.explode("groups").alias("group")).distinct()
    known = groups.groupBy(F.lower("name").alias("_name")).agg(F.min("name").alias("_known"))
    found = left_lookup(pairs.withColumn("_lower", F.lower("group")), "_lower", known, "_name")
    status = F.when(F.col("_known").isNull(), F.lit("WARN")).otherwise(F.lit("OK")).alias("status")
    return found.select("sam", F.coalesce("_known", "group").alias("group"), status).distinct()


def status_text(with_expired: bool = True, separator: str = ", ") -> Column:
    """Account status words, ``Active`` when none applies."""
    words = [
        F.when(~F.col("enabled"), F.lit("DISABLED")),
        F.when(F.col("locked_out"), F.lit("LOCKED")),
    ]
    if with_expired:
        words.append(F.when(F.col("password_expired"), F.lit("PW-EXPIRED")))
    flags = F.array_compact(F.array(*words))
    return F.when(F.size(flags) > 0, F.array_join(flags, separator)).otherwise(F.lit("Active"))


def user_summary(users: DataFrame) -> DataFrame:
    """Account summary with manager name, status and dates as text."""
    managers = users.groupBy(F.col("sam").alias("_sam")).agg(F.min("name").alias("_name"))
    joined = left_lookup(users, "manager", managers, "_sam")
    or_na = {c: F.coalesce(F.col(c), F.lit("N/A")) for c in ("dept", "title", "mail")}
    return joined.select(
        F.col("name").alias("display_name"),
        F.col("sam").alias("username"),
        or_na["dept"].alias("department"),
        or_na["title"].alias("title"),
        F.coalesce("_name", "manager", F.lit("N/A")).alias("manager"),
        or_na["mail"].alias("email"),
        status_text().alias("status"),
        date_or("last_logon", "Never").alias("last_logon"),
        date_or("password_last_set", "Never").alias("pw_last_set"),
    )


def find_users(users: DataFrame, q: str) -> DataFrame:
    """Users whose account, display name or mail contains the text, by name."""
    hit = contains_text("sam", q) | contains_text("name", q) | contains_text("mail", q)
    return (
        users.filter(hit)
        .select("name", "sam", "dept", status_text(False, ",").alias("status"))
        .orderBy("name", "sam")
    )


def member_counts(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members per group; empty groups give 0."""
    counts = pairs.groupBy(F.col("group").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return groups.select("name").join(counts, "name", "left").select(
        "name", F.coalesce("members", F.lit(0)).alias("members")
    )


def list_groups(groups: DataFrame, pairs: DataFrame, like: str = "GRP-") -> DataFrame:
    """Groups whose name contains the text, with member counts, by name."""
    return member_counts(groups.filter(contains_text("name", like)), pairs).orderBy("name")


def reporting_lines(users: DataFrame) -> DataFrame:
    """(sam, manager) pairs whose manager exists; an account listed twice counts once as a manager."""
    people = users.groupBy(F.col("sam").alias("manager")).agg(F.min("name").alias("manager_name"))
    return users.select("sam", "manager").join(people, "manager").select("sam", "manager", "manager_name")


def verify_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (kind, name) rows with PASS or FAIL and the found detail."""
    found = actual.groupBy("kind", "name").agg(
        F.max("detail").alias("detail"), F.lit(True).alias("_found")
    )
    return expected.join(found, ["kind", "name"], "left").select(
        "kind",
        "name",
        F.when(F.col("_found"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result"),
        "detail",
    )


def inventory_failures(checks: DataFrame) -> DataFrame:
    """Total failures in one row, 0 when all passed."""
    return checks.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("result") == "FAIL").alias("failures")
    )


#: Names that one task compares with the texts of one piece, on average; a piece of more names is split.
PIECE_NAMES = 10_000


def _grams(text: Column, n: int) -> Column:
    """Structs of the pieces of ``n`` letters and where they begin, from 1 on."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.substr(text, i, F.lit(n)).alias("gram"), i.alias("pos")))


def suggest_groups(wanted: DataFrame, groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups whose name contains each ``wanted`` text, without case; the first ``limit`` by name if given.

    Instead of comparing every text with every name, names are indexed by their short pieces and
    where these stand.  A text is matched through its rarest three-letter piece (or itself when
    shorter): the name must hold the text where the piece says.  Pieces of many names are split over
    salts on the index side, and their texts are sent to every salt.
    """
    names = groups.select("name", F.lower("name").alias("_n")).distinct()
    pieces = F.flatten(F.array(*[_grams(F.col("_n"), n) for n in (1, 2, 3)]))
    index = names.select("name", "_n", F.explode(pieces).alias("piece")).select("name", "_n", "piece.*")
    freq = index.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    texts = wanted.select("wanted", F.lower("wanted").alias("_w")).filter(F.length("_w") > 0).distinct()
    own = F.when(F.length("_w") < 3, F.array(F.struct(F.col("_w").alias("gram"), F.lit(1).alias("pos")))).otherwise(_grams(F.col("_w"), 3))
    parts = F.ceil(F.col("freq") / PIECE_NAMES).cast("int")
    rarest = (
        texts.select("wanted", "_w", F.explode(own).alias("piece"))
        .join(freq.select(F.col("gram").alias("_g"), "freq"), F.col("piece.gram") == F.col("_g"))
        .groupBy("wanted", "_w")
        .agg(F.min(F.struct("freq", "piece")).alias("pick"), F.count(F.lit(1)).alias("_found"), F.min("freq").alias("freq"))
        .filter(F.col("_found") == F.when(F.length("_w") < 3, 1).otherwise(F.length("_w") - 2))  # a piece in no name: no match
        .select("wanted", "_w", F.col("pick.piece.gram").alias("gram"), F.col("pick.piece.pos").alias("_at"),
                F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    )
    hot = freq.filter(F.col("freq") > PIECE_NAMES).select(F.col("gram").alias("_g"), parts.alias("_parts"))
    salted = left_lookup(index, "gram", hot, "_g").withColumn(
        "salt", F.pmod(F.xxhash64("name"), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    start = F.col("pos") - F.col("_at") + 1
    held = (start >= 1) & (F.substr("_n", start, F.length("_w")) == F.col("_w"))
    found = rarest.join(salted, ["gram", "salt"]).filter(held).select("wanted", "name").distinct()
    if limit is not None:
        by_name = Window.partitionBy("wanted").orderBy("name")
        found = found.withColumn("_k", F.row_number().over(by_name)).filter(F.col("_k") <= limit)
    return found.groupBy("wanted").agg(F.sort_array(F.collect_list("name")).alias("suggestions"))


def plan_group_changes(
    requests: DataFrame, users: DataFrame, groups: DataFrame, pairs: DataFrame, suggestions: int | None = None
) -> DataFrame:
    """Decision per request (request_id, sam, group, action Add/Remove).

    Names compare without case and come back as the directory spells them.  A missing group fails with suggestions, adding
    a member or removing a non-member is skipped, anything else succeeds;
    removals from privileged groups carry a warning flag.  ``suggestions``
    limits the names that are suggested per group.
    """
    catalogue = groups.groupBy(F.lower("name").alias("_g")).agg(F.min("name").alias("group_name"))
    accounts = users.groupBy(F.lower("sam").alias("_s")).agg(F.min("sam").alias("user_name"))
    member = pairs.select(
        F.lower("sam").alias("_s"), F.lower("group").alias("_g"), F.lit(True).alias("is_member")
    ).distinct()
    named = requests.withColumns({"_s": F.lower("sam"), "_g": F.lower("group")})
    named = left_lookup(left_lookup(named, "_g", catalogue.withColumnRenamed("_g", "_c"), "_c"),
                        "_s", accounts.withColumnRenamed("_s", "_a"), "_a")
    base = named.join(member, ["_s", "_g"], "left")
    missing = requests.select(F.col("group").alias("wanted")).distinct().join(
        catalogue, F.lower("wanted") == F.col("_g"), "left_anti"
    )
    hints = suggest_groups(missing, groups, suggestions)
    add = F.col("action") == "Add"
    member_now = F.coalesce("is_member", F.lit(False))
    result = (
        F.when(F.col("user_name").isNull(), F.lit("FAILED — user not found"))
        .when(F.col("group_name").isNull(), F.lit("FAILED — group not found"))
        .when(add & member_now, F.lit("Skipped — already a member"))
        .when(~add & ~member_now, F.lit("Skipped — not a member"))
        .otherwise(F.lit("SUCCESS"))
    )
    return (
        left_lookup(base, "group", hints, "wanted")
        .withColumn("result", result)
        .select(
            "request_id",
            F.coalesce("user_name", "sam").alias("sam"),
            F.coalesce("group_name", "group").alias("group"),
            "action",
            "result",
            (~add & member_now & F.col("group").rlike(vocab.REMOVAL_WARNING_GROUP)).alias("privileged_warning"),
            "suggestions",
        )
    )


def apply_group_changes(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Membership set after the successful decisions; names compare without case."""
    done = decisions.filter(F.col("result") == "SUCCESS").select("sam", "group", "action")
    added = done.filter(F.col("action") == "Add").select("sam", "group")
    removed = done.filter(F.col("action") == "Remove").select(F.lower("sam").alias("_s"), F.lower("group").alias("_g"))
    held = pairs.select("sam", "group").unionByName(added).distinct()
    gone = (F.lower(held.sam) == F.col("_s")) & (F.lower(held.group) == F.col("_g"))
    return held.join(removed.distinct(), gone, "left_anti")


def is_member(pairs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose (sam, group) pair is a membership already, without case."""
    held = pairs.select(F.lower("sam").alias("_s"), F.lower("group").alias("_g")).distinct()
    return requests.join(held, (F.lower("sam") == F.col("_s")) & (F.lower("group") == F.col("_g")), "left_semi")


def removable_groups(pairs: DataFrame) -> DataFrame:
    """Memberships an offboarding removes: all but the default group."""
    return pairs.filter(F.col("group") != vocab.DEFAULT_GROUP)


def offboarding_report(
    requests: DataFrame, users: DataFrame, pairs: DataFrame, today, disabled_ou: str = vocab.DISABLED_OU
) -> DataFrame:
    """Offboarding facts and report text per request (username, reason, agent, ticket).

    Built-in administrator accounts are refused.  Group lists are gathered for
    requested users only, and are bounded by the group catalogue.
    """
    day = as_datetime(today).date()
    asked = requests.join(users, F.col("username") == F.col("sam"))
    lists = (
        removable_groups(pairs)
        .join(requests.select(F.col("username").alias("sam")).distinct(), "sam", "left_semi")
        .groupBy("sam")
        .agg(F.sort_array(F.collect_set("group")).alias("_groups"))
    )
    refused = F.col("sam").rlike(vocab.PROTECTED_ACCOUNT)
    rows = asked.join(lists, "sam", "left").withColumn(
        "groups_removed", F.coalesce("_groups", F.array().cast("array<string>"))
    )
    facts = rows.select(
        "username",
        F.col("name").alias("employee"),
        F.coalesce("dept", F.lit("N/A")).alias("department"),
        "reason",
        "agent",
        "ticket",
        "title",
        "mail",
        "manager",
        F.when(refused, F.lit("REFUSED")).otherwise(F.lit("DONE")).alias("decision"),
        F.when(~refused, F.col("groups_removed")).alias("groups_removed"),
        F.when(~refused, F.size("groups_removed")).alias("n_groups"),
        F.when(
            ~refused,
            F.concat(
                F.lit(f"DEPARTED {day} | Reason: "), "reason", F.lit(" | Offboarded by: "), "agent",
                F.lit(" | Ticket: "), F.coalesce("ticket", F.lit("")),
            ),
        ).alias("description"),
        F.when(~refused, F.concat(F.lit("[DEPARTED] "), "name")).alias("display_name"),
        F.when(~refused, F.lit(disabled_ou)).alias("moved_to"),
        F.lit(day).alias("report_date"),
        F.when(~refused, F.date_add(F.lit(day), vocab.RETENTION_DAYS)).alias("delete_after"),
    )
    none = F.when(F.size("groups_removed") == 0, F.lit("  (none)"))
    listed = F.array_join(F.transform("groups_removed", lambda g: F.concat(F.lit("  - "), g)), "\n")
    line = F.lit("═" * 55)
    facts_text = [F.concat(F.lit(f"{name.ljust(14)}: "), F.coalesce(F.col(c), F.lit(""))) for name, c in vocab.REPORT_FIELDS.items()]
    steps = [
        F.lit("  [OK] Account disabled"), F.concat(F.lit("  [OK] Description: "), "description"),
        F.concat(F.lit("  [OK] Display name: "), "display_name"), F.concat(F.lit("  [OK] Moved to: "), "moved_to"),
        F.concat(F.lit("  [OK] Groups removed: "), F.col("n_groups").cast("string")),
    ]
    follow_up = [F.lit(f"  [ ] {x}") for x in vocab.FOLLOW_UP]
    text = F.concat_ws(
        "\n", line, F.lit("EMPLOYEE OFFBOARDING AUDIT REPORT"), line, F.concat(F.lit("Date          : "), F.col("report_date").cast("string")),
        *facts_text, F.lit("\nACTIONS PERFORMED:"), *steps,
        F.concat(F.lit("\nGROUPS REMOVED ("), F.col("n_groups").cast("string"), F.lit("):")), F.coalesce(none, listed),
        F.lit("\nGROUPS FAILED TO REMOVE (0):"), F.lit("  (none)"), F.lit("\nFOLLOW-UP ITEMS (manual — not automated):"),
        F.concat(F.lit("  [ ] Inform manager ("), F.coalesce("manager", F.lit("")), F.lit(") that account is disabled")), *follow_up,
        F.concat(F.lit("  [ ] 90-day retention: account will be deleted after: "), F.col("delete_after").cast("string")), line,
    )
    text = F.when(F.col("decision") == "DONE", text)
    return facts.withColumn("report", text).drop("title", "mail", "manager")
