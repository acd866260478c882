import json
import os

import pytest
from pyspark.sql import Row, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.streaming import feed as N, tables as T
from tests.test_scale import scale_rows


@pytest.fixture
def drop(tmp_path):
    """drop(name, rows): a new file of JSON lines in the input folder."""
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, rows):
        (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        # files are read in the order of their times, which must differ
        at = 1_700_000_000 + len(list(folder.iterdir()))
        os.utime(folder / name, (at, at))
        return str(folder)

    return write


def event(video, at, **more):
    return {"video_id": video, "title": "t", "url": "u", "tracked_at": at} | more


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_events_are_kept_verbatim_and_bad_ones_go_aside(spark, drop, tmp_path):
    rows = [event("a", "2026-01-01T00:00:00Z"), event("a", "2026-01-01T00:00:00Z"), "{not json", {"video_id": "b"}]
    folder = drop("1.json", rows)
    lines = N.read_lines(spark, folder)
    run(N.append_raw(lines, str(tmp_path / "raw"), str(tmp_path / "c1")))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    run(N.start(N.parse(lines), N.split_errors(N.parse(lines), good, dead), str(tmp_path / "c2")))
    assert spark.read.parquet(good).count() == 2
    assert {r.payload for r in spark.read.parquet(dead).where("status = 'error'").collect()} == {"{not json", '{"video_id": "b"}'}


def test_registration_keeps_the_first_and_survives_a_rerun(spark, drop, tmp_path):
    path = str(tmp_path / "items")
    folder = drop("1.json", [event("a", "2026-01-01T00:00:00Z"), event("a", "2026-01-01T00:00:00.2Z", title="later"), event("b", "2026-01-01T00:01:00Z")])
    write = N.register(path)
    run(N.start(N.first_seen(stream(spark, folder, N.PAYLOAD)), write, str(tmp_path / "c")))
    drop("2.json", [event("a", "2026-01-01T00:30:00Z", title="again"), event("c", "2026-01-01T00:30:00Z")])
    run(N.start(N.first_seen(stream(spark, folder, N.PAYLOAD)), write, str(tmp_path / "c")))
    stored = T.read_log(spark, path, N.ITEM)
    assert sorted((r.external_id, r.title) for r in stored.collect()) == [("a", "t"), ("b", "t"), ("c", "t")]
    last = stored.agg(F.max("batch")).first()[0]
    again = spark.createDataFrame([("c", "t", "u", None, None, None)], "video_id string, title string, url string, channel string, duration_seconds int, transcript string")
    write(again.withColumn("tracked_at", F.lit("2026-01-01 00:30:00").cast("timestamp")), last)
    assert T.read_log(spark, path, N.ITEM).count() == 3


def test_cool_down(spark, drop, tmp_path):
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    folder = drop("1.json", [{"item": "a", "at": at(0)}, {"item": "a", "at": at(89)}, {"item": "a", "at": at(90)}, {"item": "b", "at": at(5)}])
    seen = []
    out = N.throttle(stream(spark, folder, "item string, at timestamp"))
    write = lambda df, _: seen.extend((r.item, r.at % 3600) for r in df.collect())
    run(N.start(out, write, str(tmp_path / "c")))
    drop("2.json", [{"item": "a", "at": at(179)}, {"item": "a", "at": at(180)}])
    run(N.start(N.throttle(stream(spark, folder, "item string, at timestamp")), write, str(tmp_path / "c")))
    assert sorted(seen) == [("a", 0), ("a", 90), ("a", 180), ("b", 5)]
    rows = spark.read.schema("item string, at timestamp").json(folder)
    assert sorted((r.item, r.at % 3600) for r in N.throttle_rows(rows).collect()) == sorted(seen)


def test_work_not_reported_in_time_is_incomplete(spark, drop, tmp_path):
    row = lambda i, m, done: {"item": i, "at": f"2026-01-01T00:{m:02d}:00Z", "done": done}
    schema = "item string, at timestamp, done boolean"
    folder = drop("1.json", [row("a", 0, False), row("b", 0, False)])
    drop("2.json", [row("b", 3, True), row("c", 9, False)])
    drop("3.json", [row("d", 10, True)])
    seen = []
    run(N.start(N.time_out(stream(spark, folder, schema)), lambda df, _: seen.extend((r.item, r.motivo) for r in df.collect()), str(tmp_path / "c")))
    assert seen == [("a", "enriquecimiento_incompleto")]


def test_time_out_asks_the_store_once_a_key():
    """One question per key and run, no output for nothing, and the same item that is held is not written again."""
    class Store:
        def __init__(self):
            self.asked, self.value, self.timers = 0, None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.asked += 1
            return self.value

        def exists(self):
            self.asked += 1
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    store, watch = Store(), N.Watch(60)
    watch.init(store)
    see = lambda *rows: [(r["item"], r["started"]) for r in watch.handleInputRows(("a",), iter(
        [Row(us=s * 1_000_000, done=done) for s, done in rows]), None)]
    assert see((0, False), (10, False)) == [] and (store.value, store.timers, store.asked) == ((0,), {60_000}, 1)
    assert see((100, False), (90, False)) == [("a", 0)] and (store.value, store.timers) == ((90_000_000,), {150_000})
    assert see((95, None)) == [] and store.value == (90_000_000,)
    assert see((120, True)) == [] and (store.value, store.timers, store.asked) == (None, set(), 4)
    assert see((200, False)) == [] and store.asked == 5
    assert [r["started"] for r in watch.handleExpiredTimer(("a",), None, None)] == [200_000_000]
    assert list(watch.handleExpiredTimer(("a",), None, None)) == [] and store.asked == 7


def test_status_and_error_come_from_the_same_attempt(spark, drop, tmp_path):
    row = lambda s, e, m: {"external_id": "a", "enrichment_status": s, "enrichment_error": e, "enricher_version": "v", "enriched_at": f"2026-01-01T00:0{m}:00Z"}
    path = str(tmp_path / "o")
    folder = drop("1.json", [row("error", "sin_creditos", 1), row("ok", "left over", 3), row("error", "x", 2)])
    run(N.start(stream(spark, folder, N.OUTCOME), N.write_outcomes(path), str(tmp_path / "c")))
    assert [(r.enrichment_status, r.enrichment_error) for r in N.outcomes(spark, path).collect()] == [("ok", None)]
    drop("2.json", [row("error", "y", 5)])
    run(N.start(stream(spark, folder, N.OUTCOME), N.write_outcomes(path), str(tmp_path / "c")))
    assert [(r.enrichment_status, r.enrichment_error) for r in N.outcomes(spark, path).collect()] == [("error", "y")]


def test_burst_and_day_windows(spark, drop, tmp_path):
    row = lambda u, at, m=10.0: {"user_id": u, "watched_at": at, "minutos": m}
    schema = "user_id int, watched_at timestamp, minutos double"
    folder = drop("1.json", [row(1, "2026-01-01T22:50:00Z"), row(1, "2026-01-01T23:19:59Z"), row(1, "2026-01-01T23:50:00Z"), row(2, "2026-01-01T22:55:00Z")])
    drop("2.json", [row(9, "2026-01-05T00:00:00Z")])
    drop("3.json", [row(9, "2026-01-05T00:01:00Z")])         # rows are late against the watermark of the batch before
    drop("4.json", [row(1, "2026-01-01T10:00:00Z")])         # too late for either window
    bursts, days = [], []
    run(N.start(N.burst_windows(stream(spark, folder, schema)), lambda df, _: bursts.extend((r.user_id, r.videos) for r in df.collect()), str(tmp_path / "c1")))
    run(N.start(N.day_windows(stream(spark, folder, schema)), lambda df, _: days.extend((r.user_id, r.dia, r.videos, r.minutos) for r in df.collect()), str(tmp_path / "c2")))
    assert sorted(bursts) == [(1, 1), (1, 2), (2, 1)]
    assert sorted(days) == [(1, "2026-01-01", 1, 10.0), (1, "2026-01-02", 2, 20.0), (2, "2026-01-01", 1, 10.0)]


ITEMS = """id long, transcript string, title string, description string, category_id string, duration_seconds int,
 transcript_lang string, transcript_fetched_at timestamp"""


def test_gold_rows_are_kept_up_to_date(spark, drop, tmp_path):
    from contentgauge.operators import placement as P
    from contentgauge.operators.indicators import describe

    text = " ".join(f"palabra{i}" for i in range(1500))
    row = lambda i, t, at: {"id": i, "transcript": t, "title": "palabra", "category_id": "25", "duration_seconds": 600, "transcript_lang": "es", "transcript_fetched_at": at}
    scale = scale_rows(spark)
    empty = spark.createDataFrame([], ITEMS)
    computed = F.lit("2026-01-02 00:00:00").cast("timestamp")
    schema = P.gold_rows(P.panel_rows(describe(N.with_strata(empty)), scale, "id"), computed, key="id").schema
    path, write_at = str(tmp_path / "gold"), lambda at: N.maintain_gold(path, scale, schema, computed_at=F.lit(at).cast("timestamp"))
    folder = drop("1.json", [row(1, text, "2026-01-01T00:00:00Z"), row(2, "corto", "2026-01-01T00:00:00Z")])
    run(N.start(stream(spark, folder, ITEMS), write_at("2026-01-02 00:00:00"), str(tmp_path / "c")))
    now = {r.content_item_id: r for r in T.current(T.read_log(spark, path, schema), ["content_item_id"], ["computed_at"]).collect()}
    assert (now[1].apto, now[1].ritmo_ppm, now[1].ritmo_ppm_pct, len(now[1].panel)) == (True, 150.0, 100.0, 8)
    assert (now[2].apto, now[2].motivo_no_apto, now[2].panel) == (False, "transcripcion_incompleta", None)
    # 1 is fresh and stays; with a transcript fetched later it is measured again
    drop("2.json", [row(1, text + " mas", "2026-01-01T12:00:00Z")])
    run(N.start(stream(spark, folder, ITEMS), write_at("2026-01-03 00:00:00"), str(tmp_path / "c")))
    assert T.read_log(spark, path, schema).where("content_item_id = 1").count() == 1
    drop("3.json", [row(1, text + " mas", "2026-01-02T12:00:00Z")])
    run(N.start(stream(spark, folder, ITEMS), write_at("2026-01-03 00:00:00"), str(tmp_path / "c")))
    rows = T.read_log(spark, path, schema).where("content_item_id = 1")
    assert sorted(r.n_words for r in rows.collect()) == [1500, 1501] and L.FRAME_VERSION == rows.first().frame_version
    before = sorted(map(str, T.current(T.read_log(spark, path, schema), ["content_item_id"], ["computed_at"]).collect()))
    T.compact(spark, path, schema, ["content_item_id"], ["computed_at"])
    log = T.read_log(spark, path, schema)
    assert sorted(map(str, T.current(log, ["content_item_id"], ["computed_at"]).collect())) == before
    assert log.where("content_item_id = 1").first().n_words == 1501 and log.select("batch").distinct().count() == 1
