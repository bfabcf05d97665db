"""Ownership scopes, quota and admission ledgers, legacy seeding, deletion, job states."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .running import first_per_group, latest_per_group

# child table -> (parent table, child column, parent column)
OWNED_THROUGH = {
    "files": ("repositories", "repository_id", "id"),
    "symbols": ("files", "file_id", "id"),
    "code_chunks": ("repositories", "repository_id", "id"),
    "vectors": ("repositories", "repository_id", "id"),
    "analysis_issues": ("repositories", "repository_id", "id"),
    "repository_jobs": ("repositories", "repository_id", "id"),
    "repository_summaries": ("repositories", "repository_id", "id"),
    "conversations": ("repositories", "repository_id", "id"),
    "messages": ("conversations", "conversation_id", "id"),
}


def owned_repositories(repositories, owner):
    """Repositories of one account; rows without an owner are visible to nobody."""
    return repositories.filter(F.col("owner_id") == owner)


def owned_scope(table, parents, child_key, parent_key="id", owner=None):
    """Child rows visible through a parent that has an owner (or exactly this one)."""
    visible = parents.filter(F.col("owner_id").isNotNull() if owner is None else F.col("owner_id") == owner)
    return table.join(
        visible.select(F.col(parent_key).alias(child_key), "owner_id"), child_key, "inner"
    )


def _through_owner(tables, repositories, links, how):
    """Reduce every table along its chain of parents with semi joins; `how` applies to the outermost step."""
    kept = {"repositories": repositories}

    def parents_of(name):
        if name not in kept:
            parent, child_key, parent_key = links[name]
            keys = parents_of(parent).select(F.col(parent_key).alias(child_key))
            kept[name] = tables[name].join(keys, child_key, "left_semi")
        return kept[name]

    out = {}
    for name, (parent, child_key, parent_key) in links.items():
        if name in tables:
            keys = parents_of(parent).select(F.col(parent_key).alias(child_key))
            out[name] = tables[name].join(keys, child_key, how)
    return out


def owned_tables(tables, owner, links=None):
    """All rows that belong to an account, table by table (nested IN as chained semi joins)."""
    links = links or OWNED_THROUGH
    mine = owned_repositories(tables["repositories"], owner)
    out = {"repositories": mine, **_through_owner(tables, mine, links, "left_semi")}
    if "analysis_admissions" in tables:
        out["usage_history"] = tables["analysis_admissions"].filter(F.col("owner_id") == owner)
    return out


def cascade_delete(tables, doomed, links=None):
    """What remains of every table once the `doomed` repositories and everything below them are gone.

    Rows whose parent does not exist at all are kept, exactly like a delete over ids would keep them.
    """
    links = links or OWNED_THROUGH
    gone = tables["repositories"].join(doomed.select("id").distinct(), "id", "left_semi")
    rest = tables["repositories"].join(doomed.select("id").distinct(), "id", "left_anti")
    return {"repositories": rest, **_through_owner(tables, gone, links, "left_anti")}


def delete_account(tables, owner, links=None):
    """Cascade over an account's repositories, plus its ledger and usage rows."""
    out = cascade_delete(tables, owned_repositories(tables["repositories"], owner), links)
    for name in ("analysis_admissions", "account_usage"):
        if name in tables:
            out[name] = tables[name].filter(F.col("owner_id") != owner)
    return out


def owned_ids(repositories, admissions, owner):
    """Current repositories and ledger entries of an account; deleted ones still hold storage."""
    return (
        repositories.filter(F.col("owner_id") == owner).select("id")
        .union(admissions.filter(F.col("owner_id") == owner).select(F.col("repository_id").alias("id")))
        .distinct()
    )


def storage_conflicts(repositories, ids, owner):
    """Claimed ids that belong to somebody else or to nobody."""
    return repositories.join(ids, "id", "left_semi").filter(
        (F.col("owner_id") != owner) | F.col("owner_id").isNull()
    )


def usage(admissions, limit=V.LIFETIME_IMPORTS):
    """Used, reserved and remaining imports per owner."""
    return (
        admissions.groupBy("owner_id")
        .agg(
            F.count_if(F.col("status") == "COMPLETED").alias("used"),
            F.count_if(F.col("status") == "RESERVED").alias("reserved"),
        )
        .withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("used") - F.col("reserved")))
    )


def queue_depth(admissions, total_limit=V.QUEUE_TOTAL, own_limit=V.QUEUE_PER_OWNER):
    """Open reservations per owner and overall; `full` says that the owner's next import has to wait."""
    own = (
        admissions.filter("status = 'RESERVED'")
        .groupBy("owner_id")
        .agg(F.count("*").alias("own_pending"))
    )
    # grouping sets: the grand total is the row without an owner
    everyone = own.rollup("owner_id").agg(F.sum("own_pending").alias("own_pending"))
    total = everyone.filter("owner_id is null").select(F.col("own_pending").alias("all_pending"), F.lit(1).alias("_j"))
    return (
        own.withColumn("_j", F.lit(1))
        .join(F.broadcast(total), "_j")  # one row
        .drop("_j")
        .withColumn(
            "full", (F.col("all_pending") >= total_limit) | (F.col("own_pending") >= own_limit)
        )
    )


def queue_over_time(reservations, total_limit=V.QUEUE_TOTAL, own_limit=V.QUEUE_PER_OWNER, shard_seconds=3600):
    """Open reservations, overall and of its owner, at the moment before each one starts: the queue of every request.

    reservations: (repository_id, owner_id, started_at, ended_at), ended_at null while open; they start in the order of
    (started_at, repository_id), and one that ends at a moment has left before others start.  A sweep over starts and
    ends: time is cut into shards, whose sums are pre-aggregated and carried from shard to shard (a row per shard);
    rows are only sorted inside a shard.  `full` says that a limit was reached, so the request had to wait.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    who = ["repository_id", "owner_id"]
    lasts = F.coalesce(F.col("ended_at") > F.col("started_at"), F.lit(True))  # one that ends as it starts is never open
    starts = reservations.select(*who, at("started_at").alias("_t"), F.lit(1).alias("_kind"), lasts.cast("int").alias("_delta"))
    ends = reservations.filter("ended_at > started_at").select(*who, at("ended_at").alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_delta"))
    events = starts.unionByName(ends).withColumn("_shard", F.floor(F.col("_t") / (shard_seconds * 1_000_000)))

    def before(rows, keys, name):
        carried = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
        sums = rows.groupBy(*keys, "_shard").agg(F.sum("_delta").alias("_sum")).withColumn("_carried", F.coalesce(F.sum("_sum").over(carried), F.lit(0))).drop("_sum")
        inside = W.partitionBy(*keys, "_shard").orderBy("_t", "_kind", "repository_id").rowsBetween(W.unboundedPreceding, -1)
        counted = rows.join(sums, [*keys, "_shard"])
        return counted.withColumn(name, F.col("_carried") + F.coalesce(F.sum("_delta").over(inside), F.lit(0))).drop("_carried")

    judged = before(before(events, [], "all_pending"), ["owner_id"], "own_pending").filter("_kind = 1")
    return judged.select(*who, "all_pending", "own_pending", ((F.col("all_pending") >= total_limit) | (F.col("own_pending") >= own_limit)).alias("full"))


def cached_imports(requests, admissions, repositories):
    """Newest usable import of the same owner, source and revision for every request."""
    usable = (
        admissions.filter(F.col("status").isin("RESERVED", "COMPLETED"))
        .join(
            repositories.filter(F.col("status") != "FAILED").select(F.col("id").alias("repository_id"), "owner_id"),
            ["repository_id", "owner_id"],
        )
    )
    keys = ["owner_id", "source_key", "revision"]
    newest = latest_per_group(usable, keys, [F.col("created_at"), F.col("repository_id")], ["repository_id"], "cached_")
    return requests.join(newest, keys, "left")


def changed_revisions(requests, admissions):
    """Requests whose source was imported before at another revision; these need a confirmation."""
    # another revision exists exactly when the smallest or the greatest one differs
    done = (
        admissions.filter("status = 'COMPLETED'")
        .groupBy("owner_id", "source_key")
        .agg(F.min("revision").alias("_low"), F.max("revision").alias("_high"))
    )
    return (
        requests.join(done, ["owner_id", "source_key"])
        .filter((F.col("_low") != F.col("revision")) | (F.col("_high") != F.col("revision")))
        .drop("_low", "_high")
    )


def replay_admissions(requests, limit=V.LIFETIME_IMPORTS, held=None):
    """Decide a whole history of import requests at once: admitted, reused, or refused.

    requests: (owner_id, source_key, revision, `at` struct or scalar that orders an owner's requests uniquely,
    `failed` boolean: the import ended in FAILED and released its slot before the next request).

    Slots are taken by the first `limit` distinct (source, revision) pairs whose import did not fail, and they
    never come back; so the outcome follows from the first request of each pair and needs no per-owner loop.
    `held` names pairs that took a slot before (owner_id, source_key, revision).
    """
    pair = ["owner_id", "source_key", "revision"]
    firsts = requests.filter(~F.col("failed")).groupBy(*pair).agg(F.min("at").alias("first_at"))
    if held is None:
        known = requests.withColumn("_known", F.lit(False))
        slots = first_per_group(firsts, "owner_id", "first_at", n=limit, rank="slot").withColumn("free", F.lit(limit))
        known = known.withColumn("_taken", F.lit(0).cast("long"))
    else:
        taken = held.groupBy("owner_id").agg(F.count("*").alias("_taken"))
        known = (
            requests.join(held.select(*pair, F.lit(True).alias("_known")), pair, "left")
            .join(taken, "owner_id", "left")
            .withColumns({"_known": F.coalesce("_known", F.lit(False)), "_taken": F.coalesce("_taken", F.lit(0))})
        )
        slots = (
            first_per_group(firsts.join(held, pair, "left_anti"), "owner_id", "first_at", n=limit, rank="slot")
            .join(taken, "owner_id", "left")
            .withColumn("free", F.lit(limit) - F.coalesce("_taken", F.lit(0)))
            .drop("_taken")
            .filter(F.col("slot") <= F.col("free"))
        )
    last_slot = slots.filter(F.col("slot") == F.col("free")).select("owner_id", F.col("first_at").alias("full_at"))
    judged = known.join(slots, pair, "left").join(last_slot, "owner_id", "left")
    again = F.col("_known") | (F.col("first_at").isNotNull() & (F.col("first_at") < F.col("at")))
    room = (F.col("_taken") < limit) & (F.col("full_at").isNull() | (F.col("at") < F.col("full_at")))
    return judged.withColumn(
        "outcome",
        F.when(again, "reused")
        .when(F.col("at") == F.col("first_at"), "admitted")
        .when(F.col("failed") & room, "admitted")
        .otherwise("refused"),
    ).drop("first_at", "slot", "free", "full_at", "_known", "_taken")


def settle(admissions, repositories):
    """Close reservations of finished imports."""
    ended = repositories.filter(F.col("status").isin("READY", "FAILED")).select(
        F.col("id").alias("repository_id"),
        F.when(F.col("status") == "READY", "COMPLETED").otherwise("FAILED").alias("_end"),
    )
    return admissions.join(ended, "repository_id", "left").withColumn(
        "status", F.when((F.col("status") == "RESERVED") & F.col("_end").isNotNull(), F.col("_end")).otherwise(F.col("status"))
    ).drop("_end")


def seed_ledger(repositories, admissions):
    """Add ledger rows for owned repositories that have none; running it twice changes nothing."""
    url = F.regexp_replace(F.rtrim(F.col("source_url"), F.lit("/")), r"\.git$", "")
    legacy = F.concat(F.lit("legacy:"), F.col("id"))
    seeded = (
        repositories.filter("owner_id is not null")
        .select(
            F.col("id").alias("repository_id"), "owner_id",
            F.when(
                (F.col("source_type") == "github") & F.col("source_url").isNotNull(),
                F.when(F.lower("source_url").startswith("https://github.com/"), F.lower(url)).otherwise(url),
            ).otherwise(legacy).alias("source_key"),
            legacy.alias("revision"),
            F.when(F.col("status") == "READY", "COMPLETED").when(F.col("status") == "FAILED", "FAILED")
            .otherwise("RESERVED").alias("status"),
            "created_at",
        )
        .dropDuplicates(["repository_id"])
    )
    return admissions.unionByName(seeded.join(admissions.select("repository_id"), "repository_id", "left_anti"))


def seed_owners(repositories, account_usage):
    owners = repositories.filter("owner_id is not null").select("owner_id").distinct()
    return account_usage.unionByName(owners.join(account_usage, "owner_id", "left_anti"))


def legacy_admissions(repositories, admissions):
    """Finished github imports whose revision is still the seeded placeholder."""
    ready = repositories.filter("status = 'READY' and source_type = 'github'").select(
        F.col("id").alias("repository_id"), "source_url"
    )
    return admissions.filter(F.col("revision").startswith("legacy:")).join(ready, "repository_id")


def conversations_active(conversations, jobs):
    """Conversations, newest first, with a flag for a reply that is being generated."""
    running = (
        jobs.filter(F.col("status").isin("PENDING", "RUNNING") & F.col("job_type").startswith("CHAT:"))
        .select(F.expr("substring(job_type, 6)").alias("id"), F.lit(True).alias("_busy"))
        .distinct()
    )
    return conversations.join(running, "id", "left").withColumn(
        "is_generating", F.coalesce("_busy", F.lit(False))
    ).drop("_busy").orderBy(F.desc("updated_at"), "id")


def busy_and_stalled(jobs, now, minutes=V.STALLED_JOB_MINUTES, done=("READY", "FAILED", "COMPLETED", "STALE")):
    """Active rows and those without an update for `minutes`."""
    active = ~F.col("status").isin(*done)
    stalled = F.col("updated_at") < now - F.expr(f"interval {int(minutes)} minutes")
    return jobs.agg(F.count_if(active).alias("busy"), F.count_if(active & stalled).alias("stalled"))


def recover_jobs(jobs):
    """Jobs that were active at a restart become FAILED with the reason for their kind."""
    open_job = F.col("status").isin("PENDING", "RUNNING")
    kind = F.when(F.col("job_type").startswith("CHAT:"), "CHAT").when(F.col("job_type") == "ANALYSIS", "ANALYSIS")
    reasons = F.create_map(*[F.lit(x) for pair in V.INTERRUPTED.items() for x in pair])
    hit = open_job & kind.isNotNull()
    return jobs.withColumn(
        "error_message", F.when(hit, F.try_element_at(reasons, kind)).otherwise(F.col("error_message"))
    ).withColumn("status", F.when(hit, "FAILED").otherwise(F.col("status")))


def recover_repositories(repositories):
    stuck = F.col("status").isin("UPLOADING", "PARSING", "INDEXING", "ANALYZING")
    return repositories.withColumn(
        "error_message", F.when(stuck, V.INTERRUPTED_IMPORT).otherwise(F.col("error_message"))
    ).withColumn("status", F.when(stuck, "FAILED").otherwise(F.col("status")))


def fail_reservations(admissions):
    return admissions.withColumn(
        "status", F.when(F.col("status") == "RESERVED", "FAILED").otherwise(F.col("status"))
    )
