"""The watch-event feed as Structured Streaming: append, dedup, throttle, write back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from contentgauge.functions import lexicons as L, strata
from contentgauge.functions.numbers import half_even
from contentgauge.operators import merge, placement
from contentgauge.operators.diet import local_time
from contentgauge.operators.indicators import describe
from contentgauge.operators.queue import GIVE_UP_SECONDS, RETRY_SECONDS
from contentgauge.operators.skew import previous_in_time, running_total
from contentgauge.streaming.tables import current, read_log, write_batch

PAYLOAD = """video_id STRING, title STRING, url STRING, channel STRING, duration_seconds INT,
 view_count_raw STRING, tracked_at TIMESTAMP, transcript STRING"""
ITEM = """external_id STRING, title STRING, url STRING, channel STRING, duration_seconds INT,
 transcript STRING, watched_at TIMESTAMP"""


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run a batch writer over everything that has arrived, then stop."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(
        availableNow=True).start()


# ------------------------------------------------------------------ N1, N10: arrival


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """One JSON text per line, verbatim."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def parse(lines: DataFrame) -> DataFrame:
    """Payload columns beside the verbatim text; ``status`` is 'error' for a text that
    does not parse or lacks the video, title or url."""
    parsed = F.from_json("value", f"{PAYLOAD}, _corrupt_record STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select(F.col("value").alias("payload"), parsed.alias("p"))
    missing = F.col("p.video_id").isNull() | F.col("p.title").isNull() | F.col("p.url").isNull()
    bad = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull() | missing
    return rows.select("payload", F.when(bad, "error").otherwise("ok").alias("status"), "p.*").drop("_corrupt_record")


def append_raw(lines: DataFrame, path: str, checkpoint: str):
    """Every event as it came, never deduplicated."""
    raw = lines.select(F.current_timestamp().alias("received_at"), F.lit("chrome_extension").alias("source"),
                       F.col("value").alias("payload"))
    return raw.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def split_errors(parsed: DataFrame, good: str, dead: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: usable rows to one log, the rest to another with their status."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        write_batch(rows.where("status = 'ok'").drop("payload", "status"), good, batch_id)
        write_batch(rows.where("status = 'error'").select("payload", "status"), dead, batch_id)
        rows.unpersist()

    return write


# ------------------------------------------------------------------ N2, A21: registration


def first_seen(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first event of every video within the delay; repeats are dropped."""
    return events.withWatermark("tracked_at", delay).dropDuplicatesWithinWatermark(["video_id"])


def items_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("video_id").alias("external_id"), "title", "url", "channel", "duration_seconds",
                         "transcript", F.col("tracked_at").alias("watched_at"))


def register(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: items not stored yet, one row per video. A batch that runs again
    does not see its own rows, so it writes the same ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = items_of(batch).persist()
        stored = read_log(batch.sparkSession, path, ITEM, rows.select("external_id")).where(F.col("batch") != batch_id)
        fresh = merge.insert_absent(stored, rows, "external_id", ["watched_at", "title"])
        write_batch(fresh, path, batch_id, "external_id")
        rows.unpersist()

    return write


# ------------------------------------------------------------------ N3, N4: throttle and time-out


def throttle(attempts: DataFrame, seconds: int = RETRY_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Attempts (item, at) a cool-down lets through. State: second of the last one, which goes
    when the watermark has passed the cool-down, so only items of that time are held. Attempts
    later than ``delay`` are dropped. An item's rows are read batch by batch and only their
    distinct seconds are held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        seconds_seen: set[int] = set()
        for batch in batches:
            seconds_seen.update(batch["second"].tolist())
        passed = []
        for second in sorted(seconds_seen):
            if last is None or second - last >= seconds:
                passed.append(second)
                last = second
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item": [key[0]] * len(passed), "at": passed})

    kind = attempts.schema["item"].dataType.simpleString()
    second = F.floor(F.unix_micros("at") / 1_000_000).cast("long")
    slim = attempts.withWatermark("at", delay).select("item", "at", second.alias("second"))
    return slim.groupBy("item").applyInPandasWithState(
        step, f"item {kind}, at bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_rows(attempts: DataFrame, seconds: int = RETRY_SECONDS) -> DataFrame:
    """The same over a table, (item, at), in columns.

    An attempt that comes ``seconds`` or more after its predecessor always passes, since whatever passed
    before lies no later than that. So an item's attempts fall into segments that know nothing of each
    other, and a segment is folded by itself. Predecessors and segment numbers are taken day by day and
    put together from a row per item and day: no task holds an item with very many attempts.
    """
    folded = attempts.select("item", F.floor(F.unix_micros("at") / 1_000_000).cast("long").alias("at")).distinct()
    folded = folded.withColumn("_ts", F.timestamp_seconds("at"))
    folded = previous_in_time(folded, "item", "_ts", "at", "_earlier")
    gap = F.col("at") - F.unix_seconds("_earlier")
    folded = folded.withColumn("_new", F.when(gap.isNull() | (gap >= seconds), 1).otherwise(0))
    folded = running_total(folded, "item", "_ts", "at", "_new", "_segment")
    segments = folded.groupBy("item", "_segment").agg(F.array_sort(F.collect_list("at")).alias("_all"))

    def step(state: Column, at: Column) -> Column:
        passes = state["last"].isNull() | (at - state["last"] >= seconds)
        return F.struct(F.when(passes, at).otherwise(state["last"]).alias("last"), F.when(
            passes, F.concat(state["out"], F.array(at))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))
    return segments.select("item", F.explode(F.aggregate("_all", begin, step, lambda state: state["out"])).alias("at"))


class Watch(StatefulProcessor):
    """A start arms an event-time timer, a report disarms it; a timer that fires, or a row that comes after its time,
    gives (item, started, motivo). State: the start, in a value that is cleared with its timer."""

    MOTIVO = "enriquecimiento_incompleto"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "us bigint")

    def _rows(self, key: Any, late: list[int]) -> Iterator[Row]:
        return (Row(item=key[0], started=at, motivo=self.MOTIVO) for at in late)

    def _due(self, started: int) -> int:
        return started // 1000 + self.seconds * 1000

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # every question to the state store is a call to the JVM: one, not first whether there is a value
        held = self.started.get()
        before = None if held is None else held[0]
        started, late = before, []
        for at, done in sorted({(row["us"], row["done"]) for row in rows}):
            if started is not None and at - started > self.seconds * 1_000_000:
                late.append(started)
                started = None
            started = None if done else (at if started is None else started)
        if before is not None and started != before:
            self.handle.deleteTimer(self._due(before))
            if started is None:
                self.started.clear()
        if started is not None and started != before:
            self.started.update((started,))
            self.handle.registerTimer(self._due(started))
        yield from self._rows(key, late)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.started.get()
        if held is not None:
            self.started.clear()
            yield from self._rows(key, [held[0]])

    def close(self) -> None:
        pass


def time_out(progress: DataFrame, seconds: int = GIVE_UP_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(item, started, motivo) of items whose work began and was not reported done in time.

    ``progress``: item, at, done. State and timers are kept by the RocksDB state store, the only one that
    holds both; it is set for the session.
    """
    progress.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = progress.schema["item"].dataType.simpleString()
    rows = progress.withWatermark("at", delay).select("item", "at", F.unix_micros("at").alias("us"), "done")
    return rows.groupBy("item").transformWithState(
        Watch(seconds), f"item {kind}, started bigint, motivo string", "Append", "EventTime")


# ------------------------------------------------------------------ N6: outcomes


OUTCOME = "external_id STRING, enrichment_status STRING, enrichment_error STRING, enricher_version STRING, enriched_at TIMESTAMP"


def write_outcomes(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: the latest attempt of every item, status and error of the same one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = merge.one_per_key(batch.select(*StructType.fromDDL(OUTCOME).fieldNames()), ["external_id"], ["enriched_at"])
        cleared = F.when(F.col("enrichment_status") == "ok", None).otherwise(F.col("enrichment_error"))
        write_batch(rows.withColumn("enrichment_error", cleared), path, batch_id, "external_id")

    return write


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return current(read_log(spark, path, OUTCOME), ["external_id"], ["enriched_at"])


# ------------------------------------------------------------------ N7, N8: windows


def burst_windows(watches: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Viewing bursts as session windows."""
    d = watches.withWatermark("watched_at", delay).groupBy("user_id", F.session_window("watched_at", gap).alias("w"))
    return d.agg(F.count(F.lit(1)).alias("videos")).select("user_id", "w.start", "w.end", "videos")


def day_windows(watches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Viewings and minutes per viewer and local day. Rows later than the watermark are
    dropped; the watermark follows local time, which jumps back once a year."""
    local = watches.withColumn("local_at", local_time(F.col("watched_at"))).withWatermark("local_at", delay)
    d = local.groupBy("user_id", F.window("local_at", "1 day").alias("w"))
    return d.agg(F.count(F.lit(1)).alias("videos"), F.sum("minutos").alias("m")).select(
        "user_id", F.date_format("w.start", "yyyy-MM-dd").alias("dia"), "videos", half_even(F.col("m"), 6).alias("minutos"))


# ------------------------------------------------------------------ N9: gold rows


def with_strata(items: DataFrame) -> DataFrame:
    return items.withColumns({"formato": strata.category_format(F.col("category_id")),
                              "duracion": strata.duration_bucket(F.col("duration_seconds"))})


def maintain_gold(path: str, scale: DataFrame, gold_schema: StructType, lexicons: dict[str, Any] | None = None,
                  frame: str = L.FRAME_VERSION, computed_at: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer: items whose stored panel is missing or stale are measured, placed
    on the scale and stored, measurable or not. ``scale`` is small and broadcast."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        log = read_log(batch.sparkSession, path, gold_schema, rows.select("id")).where(F.col("batch") != batch_id)
        stored = current(log, ["content_item_id"], ["computed_at"])
        _, misses = placement.split_by_freshness(rows, stored, frame)
        placed = placement.panel_rows(describe(with_strata(misses), lexicons), scale, "id")
        at = computed_at if computed_at is not None else F.current_timestamp()
        write_batch(placement.gold_rows(placed, at, frame, "id"), path, batch_id, "content_item_id")
        rows.unpersist()

    return write
