"""Incremental ingestion: the work queue as expressions, page cursors, and Structured Streaming over landed files."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RETRIES, LEASE_MINUTES = 3, 15
#: Hours of the day at which a pass starts.
HOURS = (7, 12, 18)


def pending(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Unfinished work with retries left, newest first."""
    rows = queue.where(F.col("status").isin("pending", "processing", "failed") & (F.coalesce("retry_count", F.lit(0)) < MAX_RETRIES)).orderBy(F.desc("created_at"), "url_hash")
    return rows.limit(limit) if limit else rows


def claimable(queue: DataFrame, now, category: str | None = None) -> DataFrame:
    """What may be claimed: pending or failed, or processing under a lease that has run out."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < F.lit(now) - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"))
    rows = queue.where((F.col("status").isin("pending", "failed") | stale) & (F.coalesce("retry_count", F.lit(0)) < MAX_RETRIES))
    return rows.where(F.col("category") == category) if category else rows


def claimed(queue: DataFrame, keys: DataFrame, now) -> DataFrame:
    """The queue with the rows of keys (url_hash) taken: processing, claimed now."""
    taken = keys.select("url_hash").distinct().withColumn("_taken", F.lit(True))
    rows = queue.join(taken, "url_hash", "left")
    return rows.withColumns({"status": F.when(F.col("_taken"), "processing").otherwise(F.col("status")), "claimed_at": F.when(F.col("_taken"), F.lit(now).cast(queue.schema["claimed_at"].dataType)).otherwise(F.col("claimed_at"))}).select(*queue.columns)


def with_outcome(queue: DataFrame, outcome: DataFrame) -> DataFrame:
    """Statuses after a batch: outcome has url_hash and ok; a failure counts as a retry."""
    joined = queue.join(outcome.select("url_hash", "ok"), "url_hash", "left")
    return joined.withColumns(
        {
            "retry_count": F.coalesce("retry_count", F.lit(0)) + F.when(F.col("ok") == False, 1).otherwise(0),  # noqa: E712
            "status": F.when(F.col("ok"), "done").when(F.col("ok").isNotNull(), "failed").otherwise(F.col("status")),
        }
    ).drop("ok")


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def progress(queue: DataFrame, now, scored: str = "summary_json", active_seconds: int = 300) -> DataFrame:
    """One row: done, pending, processing, failed, scored, and active (claimed within the last seconds)."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    fresh = (F.col("status") == "processing") & (F.col("claimed_at") > F.lit(now) - F.expr(f"INTERVAL {active_seconds} SECONDS"))
    return queue.agg(*[is_(s) for s in ("done", "pending", "processing", "failed")], F.count_if(F.col(scored).isNotNull()).alias("scored"), F.count_if(fresh).alias("active"))


def rate(before: DataFrame, after: DataFrame, seconds: float) -> DataFrame:
    """per_hour and hours_left from two rows of progress taken `seconds` apart; hours_left is null at a rate of 0 or less."""
    b, a = before.select(F.col("scored").alias("_was")), after.select("scored", "pending")
    per_hour = (F.col("scored") - F.col("_was")) / F.lit(float(seconds)) * 3600
    return b.crossJoin(a).select(per_hour.alias("per_hour"), F.when(per_hour > 0, F.col("pending") / per_hour).alias("hours_left"))  # rows of one


def fresh_urls(items: DataFrame, seen: DataFrame, cutoff=None) -> DataFrame:
    """Items not seen, once each; those older than the cutoff go, those without a date stay."""
    rows = items.withColumn("url_hash", F.sha2("url", 256)).dropDuplicates(["url_hash"])
    if cutoff is not None:
        rows = rows.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(cutoff)))
    return rows.join(seen.select("url_hash"), "url_hash", "left_anti")


def new_work(items: DataFrame, now) -> DataFrame:
    """Rows of the queue for new items: pending, no retries, created now."""
    return items.select("url_hash", F.col("url").alias("source_url"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("claimed_at"))


# --- cursors ------------------------------------------------------------------------------------------------------------


def pages_to_read(cursor: dict[str, int], categories: list[str], depth: int, most: int | None = None) -> list[tuple[str, int]]:
    """Pages of this run: of each category those after its cursor, `most` at most, none past the depth."""
    out = []
    for c in categories:
        first = cursor.get(c, 0) + 1
        out += [(c, p) for p in range(first, (min(depth, first + most - 1) if most else depth) + 1)]
    return out


def before_cutoff(items: DataFrame, cutoff, category: str = "category", page: str = "page", published: str = "published_at") -> DataFrame:
    """Items of list pages up to the first page of a category on which all are older than the cutoff, those older left out;
    items without a date count as new."""
    new = F.col(published).isNull() | (F.col(published) >= F.lit(cutoff))
    stops = stop_pages(items, cutoff, category, page, published)
    kept = items.join(stops.select(category, F.col("stop").alias("_stop")), category, "left")
    return kept.where(new & (F.col("_stop").isNull() | (F.col(page) <= F.col("_stop")))).drop("_stop")


def stop_pages(items: DataFrame, cutoff, category: str = "category", page: str = "page", published: str = "published_at") -> DataFrame:
    """category, last_page, stop: the last page read, and the first page with none but old items (null if there is none)."""
    old = F.col(published) < F.lit(cutoff)
    each = items.groupBy(category, page).agg(F.min(F.coalesce(old, F.lit(False))).alias("_old"))
    return each.groupBy(category).agg(F.max(page).alias("last_page"), F.min(F.when(F.col("_old"), F.col(page))).alias("stop"))


def moved_cursor(cursor: dict[str, int], stops: DataFrame, depth: int, category: str = "category") -> dict[str, int]:
    """The cursor after a run: a category that met its stop is complete. A row per category comes to the driver."""
    return cursor | {r[category]: depth if r.stop is not None else r.last_page for r in stops.collect()}


def load_cursor(spark: SparkSession, path: str) -> dict[str, int]:
    """The cursor at path; empty where there is none or it can't be read."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return {}
    try:
        got = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        return {str(k): int(v) for k, v in got.items()}
    except (ValueError, AttributeError, TypeError):
        return {}


def save_cursor(spark: SparkSession, path: str, cursor: dict[str, int]) -> None:
    spark.createDataFrame([(json.dumps(cursor, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def reset_cursor(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def next_start(now: dt.datetime, hours: tuple[int, ...] = HOURS) -> dt.datetime:
    """When the next pass starts: strictly later than now, at one of the hours."""
    if not hours:
        raise ValueError("no hour is given")
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return min(t for d in (0, 1) for h in hours if (t := day + dt.timedelta(days=d, hours=h)) > now)


# --- streams ------------------------------------------------------------------------------------------------------------


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily_stream(events: DataFrame, time: str, entity: str, score: str, key: str, late: str = "2 days") -> DataFrame:
    """Daily sums by entity over a stream whose repeats are dropped within the watermark."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, "1 day"), entity).agg(F.count(F.lit(1)).alias("row_count"), F.sum(score).alias("sentiment_sum"))


def drain(stream: DataFrame, work, checkpoint: str):
    """Runs `work(batch, batch_id)` over all that has landed, then ends."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gathered(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that has landed put through a stream and written to path: what a batch over the result reads. In complete mode the
    last state replaces what was written before."""
    spark = stream.sparkSession

    def write(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def work_off(queue: DataFrame, client, now, limit: int | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One pass over the queue: what may be claimed (the newest up to the limit), enriched by the client, and the queue after it.
    The queue has raw_text; a row whose client fails is failed, with a retry counted."""
    from ..sources.io import enrich

    rows = claimable(queue, now, category).orderBy(F.desc("created_at"), "url_hash")
    done = enrich((rows.limit(limit) if limit else rows).select("url_hash", "raw_text"), client)
    return done, with_outcome(queue, done.select("url_hash", F.col("summary_error").isNull().alias("ok")))
