"""Tables of records: latest row per key, summaries, search pages, upserts, set membership, job states, attempt limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least numbers of analyses for levels 1 to 5.
LEVELS = (0, 10, 50, 200, 1000)
FINAL_STATES = ("done", "failed")
PAID_STATES = ("trialing", "active", "past_due")


def latest_per_key(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """The first row of each key. Spark limits each key's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def recent(df: DataFrame, key: str, ts: str, n: int, *ties: Column) -> DataFrame:
    """The n newest keys, each by its newest row."""
    order = [F.col(ts).desc_nulls_last(), *ties]
    return latest_per_key(df, [key], *order).orderBy(*order).limit(n)


def summary(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """One row: total, recent (at or after cutoff), last_run_at. Rows are counted raw, keys repeated included."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(ts) >= cutoff).alias("recent"), F.max(ts).alias("last_run_at"))


def total_count(external: Column, last_known: Column, local: Column) -> Column:
    """A counter elsewhere if it answers (not negative), else the last known, else the local count."""
    return F.coalesce(F.when(external >= 0, external), last_known, local)


def search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows whose joined columns hold the term, whatever the case; a blank term keeps all."""
    plain = term.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(plain))) if plain else df


def ilike(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """SQL ILIKE on any column; wildcards in the term keep their meaning."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{term}%")
    return df.where(hit)


def saved_order(mode: str) -> list[Column]:
    """Sort modes of saved analyses; a missing score is last in both score orders."""
    newest, label = F.col("saved_at").desc_nulls_last(), F.col("label")
    return {
        "score_desc": [F.coalesce("score", F.lit(-1.0)).desc(), newest, label],
        "score_asc": [F.coalesce("score", F.lit(float("inf"))), newest, label],
        "newest": [newest, label],
        "oldest": [F.col("saved_at").asc_nulls_first(), label],
    }[mode]


def page(df: DataFrame, order: list[Column], index: int, size: int = 8) -> DataFrame:
    """One page of a total order, at index or the last page before it."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset(min(max(index, 0), pages - 1) * size).limit(size)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """table with changes merged in: a change replaces its key's row, whatever their versions; of several changes the newest."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, F.col("_new").desc(), F.col(version).desc()).drop("_new")


def replace_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], key: str, doomed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the doomed keys, and every child table without theirs."""
    return parent.join(doomed, key, "left_anti"), {n: c.join(doomed, key, "left_anti") for n, c in children.items()}


def selected(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen, key, "left_semi")


def unselected(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen, key, "left_anti")


def conflicts(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows whose value another row (of a different key) has too."""
    valued = df.withColumn("_v", value)
    shared = valued.groupBy("_v").agg(F.countDistinct(key).alias("_n")).where("_n > 1")
    return valued.join(shared, "_v", "left_semi").drop("_v")


def resolve_user(events: DataFrame, users: DataFrame) -> DataFrame:
    """events (user_id, subscription_id, customer_id) with resolved_id: by user, then subscription, then customer."""
    by_id = users.select(F.col("id").alias("user_id"), F.col("id").alias("_a"))
    by_sub = users.where("subscription_id is not null").groupBy("subscription_id").agg(F.min("id").alias("_b"))
    by_customer = users.where("customer_id is not null").groupBy("customer_id").agg(F.min("id").alias("_c"))
    out = events.join(by_id, "user_id", "left").join(by_sub, "subscription_id", "left").join(by_customer, "customer_id", "left")
    return out.withColumn("resolved_id", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")


def failures_in_window(attempts: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """attempts with `failures`: how many of the key's lie within the trailing window, itself included."""
    at = F.col(ts).cast("timestamp").cast("long")
    return attempts.withColumn("failures", F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)))


def too_soon(tokens: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """tokens with `since`, seconds since the key's previous one, and `refused` where that is under the interval."""
    at = F.col(ts).cast("timestamp")
    previous = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    out = tokens.withColumn("since", (F.unix_micros(at) - F.unix_micros(previous)) / 1e6)
    return out.withColumn("refused", F.coalesce(F.col("since") < seconds, F.lit(False)))


def valid_tokens(tokens: DataFrame, raw: str, now: Column) -> DataFrame:
    return tokens.where((F.col("token_hash") == F.sha2(F.lit(raw), 256)) & F.col("used_at").isNull() & (F.col("expires_at") >= now))


def job_parts(events: DataFrame, job: str, ts: str, *ties: str) -> DataFrame:
    """What a set of events says of each job: its last status and progress, each with its place in the order, first and last time, count.

    A failure leaves the progress as it was, a finished job has 100.
    """
    order = F.struct(ts, *ties)
    progress = F.when(F.col("status") == "done", 100).when(F.col("status") != "failed", F.col("progress")).cast("long")
    said = F.when(progress.isNotNull(), order)
    return events.groupBy(job).agg(
        F.max_by("status", order).alias("status"), F.max(order).alias("status_at"), F.max_by(progress, said).alias("progress"), F.max(said).alias("progress_at"),
        F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.count("*").alias("n_events"),
    )


def merge_parts(*parts: DataFrame, job: str) -> DataFrame:
    """The same of all their events together, in whatever order the parts come."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(job).agg(
        F.max_by("status", "status_at").alias("status"), F.max("status_at").alias("status_at"), F.max_by("progress", "progress_at").alias("progress"), F.max("progress_at").alias("progress_at"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("n_events").alias("n_events"),
    )


def job_states(events: DataFrame, job: str, ts: str, *ties: str) -> DataFrame:
    """Latest status and progress of each job, first and last time, from its event log."""
    return job_parts(events, job, ts, *ties).drop("status_at", "progress_at")


def newest_first(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    """By time, the newest first; rows without a time last."""
    return df.orderBy(F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(0))).desc(), *ties)


def rows_of(df: DataFrame, user: str, value, key: str | None = None, wanted=None) -> DataFrame:
    """A user's rows, or those of one key."""
    own = df.where(F.col(user) == value)
    return own if wanted is None else own.where(F.col(key) == wanted)


def row_of(df: DataFrame, user: str, value, key: str, wanted) -> DataFrame:
    """The user's row with this id: none or one."""
    return rows_of(df, user, value, key, wanted).limit(1)


def limited(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def running_totals(events: DataFrame, key: str, increment: str) -> DataFrame:
    """Each key's total; an increment counts as 1 at least."""
    return events.groupBy(key).agg(F.sum(F.greatest(F.coalesce(F.col(increment), F.lit(1)), F.lit(1))).cast("long").alias("total"))


def queued_jobs(queue: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """The queue's entries with their payload; those without one go."""
    return queue.join(jobs.where("payload is not null"), job)


def apply_updates(table: DataFrame, events: DataFrame, key: str, columns: list[str], *order: str) -> DataFrame:
    """table with each column's last written value; a null in an event writes nothing."""
    at = F.struct(*order)
    last = events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in columns))
    out = table.join(last, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def subscription_states(events: DataFrame, user: str, event: str, ts: str) -> DataFrame:
    """Each user's last status, every event counted once however often it came."""
    once = events.groupBy(event).agg(F.min(F.struct(ts, user, "status")).alias("e")).select(event, "e.*")
    return once.groupBy(user).agg(F.max_by("status", F.struct(ts, event)).alias("status"), F.max(ts).alias("since"))


def queue_depth(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(~F.col("status").isin(*FINAL_STATES)).alias("depth"))


def level(analyses: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i in range(len(LEVELS) - 1, -1, -1):
        out = out.when(analyses >= LEVELS[i], i + 1)
    return out


def is_paid(status: Column) -> Column:
    return F.coalesce(status.isin(*PAID_STATES), F.lit(False))


def role_after(role: Column, status: Column) -> Column:
    """A paid state makes a plus user, another a plain one; administrators stay."""
    return F.when(role == "admin", role).when(is_paid(status), "plus").otherwise("user")


def canonical_username(name: Column) -> Column:
    return F.lower(F.trim(name))


def attempts_left(attempts: DataFrame, key: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """The attempts that haven't expired."""
    return attempts.where(F.col(ts).cast("timestamp") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def best_image(images: DataFrame, key: str) -> DataFrame:
    """Each key's widest image (url, width, pos), in order of first appearance."""
    return images.groupBy(key).agg(F.max_by("url", F.struct("width", -F.col("pos"))).alias("url"), F.max("width").alias("width"), F.min("pos").alias("first_pos"))


def mode_first_seen(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))
