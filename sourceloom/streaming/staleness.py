"""Staleness monitor: commits since the last build per repository, over an event stream.

State has one row per repository (last build, commits behind) and the places of the recent
commits behind that build. A build that arrives after commits which lie after it leaves
those counted, so the result does not depend on how events fall into micro-batches. Commits
older than the watermark are kept as a number only: no build that still counts can lie before
them. Events that arrive behind the watermark go to a table of late events, uncounted. Every
micro-batch writes the next state to folders named by batch id, so a replayed batch gives the same
state again. Repeated events change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceloom.operators.changes import STALE_AFTER
from sourceloom.operators.skew import salted_join

PLACE = "struct<ts:timestamp,event_id:bigint>"
STATE = f"repo string, last_build {PLACE}, behind bigint, crossed boolean"
RECENT = "repo string, event_id bigint, ts timestamp"
EVENT = "event_id bigint, ts timestamp, repo string, kind string"
CLOCK = "watermark timestamp"


def commit_events(events: DataFrame) -> DataFrame:
    """Raw events as ``(event_id, ts, repo, kind)``: purchases are commits, signups builds."""
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "signup", "build")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("repo_src"), (F.col("user_id") % 20).cast("string")).alias("repo"),
        kind.alias("kind"),
    ).where(F.col("kind").isNotNull())


def newest_builds(state: DataFrame, batch: DataFrame) -> DataFrame:
    """``(repo, last_build, behind, reset)``: the newest build known, and whether this batch brought it."""
    place = F.struct("ts", "event_id").cast(PLACE)
    builds = batch.groupBy("repo").agg(F.max(F.when(F.col("kind") == "build", place)).alias("new_build"))
    reset = F.coalesce(F.col("new_build") > F.col("last_build"), F.col("new_build").isNotNull())
    return state.join(builds, "repo", "full").select(
        "repo",
        F.when(reset, F.col("new_build")).otherwise(F.col("last_build")).alias("last_build"),
        F.coalesce("behind", F.lit(0)).alias("behind"),
        reset.alias("reset"),
    )


def pending_commits(builds: DataFrame, recent: DataFrame, batch: DataFrame) -> DataFrame:
    """``(repo, event_id, ts)`` of recent and new commits after the newest build, each once."""
    fresh = batch.where(F.col("kind") == "commit").select("repo", "event_id", "ts")
    commits = recent.select("repo", "event_id", "ts").unionAll(fresh).distinct()
    joined = salted_join(commits, builds.select("repo", "last_build"), "repo", ["event_id"])
    after = F.col("last_build").isNull() | (F.struct("ts", "event_id").cast(PLACE) > F.col("last_build"))
    return joined.where(after).select("repo", "event_id", "ts")


def state_after(builds: DataFrame, recent: DataFrame, pending: DataFrame, threshold: int = STALE_AFTER) -> DataFrame:
    """State after a batch; ``crossed`` marks repositories that just became stale.

    What was behind before and is no recent commit is older than the watermark: it stays counted
    until a newer build comes.
    """
    were = recent.groupBy("repo").agg(F.count("*").alias("were"))
    now = pending.groupBy("repo").agg(F.count("*").alias("now"))
    older = F.when(F.col("reset"), F.lit(0)).otherwise(F.col("behind") - F.coalesce("were", F.lit(0)))
    behind = older + F.coalesce("now", F.lit(0))
    return builds.join(were, "repo", "left").join(now, "repo", "left").select(
        "repo",
        "last_build",
        behind.alias("behind"),
        ((behind > threshold) & (F.col("behind") <= threshold)).alias("crossed"),
    )


def next_state(state: DataFrame, batch: DataFrame, recent: DataFrame | None = None, threshold: int = STALE_AFTER) -> DataFrame:
    """State after a batch in one step, for callers that keep no recent commits."""
    if recent is None:
        recent = state.sparkSession.createDataFrame([], RECENT)
    builds = newest_builds(state, batch)
    return state_after(builds, recent, pending_commits(builds, recent, batch), threshold)


def _read(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What the batch before wrote, empty for the first one."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id - 1}")


def start(events: DataFrame, table: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Run over what is available; ``events`` comes from ``commit_events``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = _read(spark, f"{table}/_clock", CLOCK, batch_id)
        watermark = clock.agg(F.max("watermark")).scalar()
        on_time = F.coalesce(F.col("ts") >= watermark, F.lit(True))
        late = batch.where(~on_time)
        late.write.mode("overwrite").parquet(f"{table}/_late/batch_id={batch_id}")
        batch = batch.where(on_time)
        state = _read(spark, table, STATE, batch_id)
        recent = _read(spark, f"{table}/_recent", RECENT, batch_id).where(on_time)
        builds = newest_builds(state, batch)
        here = f"{table}/_recent/batch_id={batch_id}"
        pending_commits(builds, recent, batch).write.mode("overwrite").parquet(here)
        pending = spark.read.schema(RECENT).parquet(here)
        state_after(builds, recent, pending).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        ahead = batch.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("watermark"))
        ahead.unionAll(clock).agg(F.max("watermark").alias("watermark")).write.mode("overwrite").parquet(
            f"{table}/_clock/batch_id={batch_id}"
        )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_events(spark: SparkSession, table: str) -> DataFrame:
    """Events that came behind the watermark of their batch."""
    return spark.read.schema(EVENT + ", batch_id bigint").parquet(f"{table}/_late").drop("batch_id")


def report(spark: SparkSession, table: str, threshold: int = STALE_AFTER) -> DataFrame:
    """Newest state with the staleness verdict."""
    states = spark.read.schema(STATE + ", batch_id bigint").parquet(table)
    last = states.agg(F.max("batch_id")).scalar()
    return states.where(F.col("batch_id") == last).select(
        "repo", "behind", (F.col("last_build").isNull() | (F.col("behind") > threshold)).alias("stale")
    )
