import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L
from contentgauge.operators import sampling as SA, skew as SK

SCHEMA = "external_id string, channel_id string, stratum_format string, stratum_duration string, sampling_source string, duration_seconds int"
CELLS = [(f, d) for f in L.FORMATS for d in L.DURATIONS]


def pool(spark, rows):
    return spark.createDataFrame([(f"v{i}", c, f, d, "chart_canal" if i % 2 else "busqueda_semilla", 600) for i, (c, (f, d)) in enumerate(rows)], SCHEMA)


def drawn(df):
    rows = df.collect()
    main = [r for r in rows if r.sample_rank == "principal"]
    return main, [r for r in rows if r.sample_rank == "reserva"]


def check(main, quota, cap):
    assert max(Counter((r.stratum_format, r.stratum_duration) for r in main).values()) <= quota
    assert max(Counter(r.channel_id for r in main).values()) <= cap
    assert len({r.external_id for r in main}) == len(main)


def test_every_cell_is_filled_when_channels_suffice(spark):
    rng = random.Random(1)
    rows = [(f"c{rng.randrange(200)}", rng.choice(CELLS)) for _ in range(1500)] + [(None, c) for c in CELLS]
    main, spare = drawn(SA.stratified_draw(pool(spark, rows), 60, 2, 3, "9"))
    check(main, 5, 2)
    assert len(main) == 60 and all(n == 5 for n in Counter((r.stratum_format, r.stratum_duration) for r in main).values())
    assert max(Counter(r.channel_id for r in main).values()) == 1        # unused channels come first
    assert all(n == 3 for n in Counter((r.stratum_format, r.stratum_duration) for r in spare).values())
    assert not {r.external_id for r in main} & {r.external_id for r in spare}


def test_one_channel_feeds_all_cells(spark):
    rows = [("only", c) for c in CELLS for _ in range(10)]
    main, _ = drawn(SA.stratified_draw(pool(spark, rows), 24, 2, 5, "9"))
    assert len(main) == 2


def test_draw_does_not_depend_on_row_order_and_follows_the_seed(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(25)}", rng.choice(CELLS)) for _ in range(400)]
    df = pool(spark, rows)
    a = {r.external_id for r in drawn(SA.stratified_draw(df, 36, 2, 2, "1"))[0]}
    b = {r.external_id for r in drawn(SA.stratified_draw(df.orderBy(F.desc("external_id")).repartition(7), 36, 2, 2, "1"))[0]}
    c = {r.external_id for r in drawn(SA.stratified_draw(df, 36, 2, 2, "2"))[0]}
    assert a == b and a != c


def test_contenders_are_bounded_and_enough(spark):
    rows = [("big", CELLS[0]) for _ in range(300)] + [(f"c{i}", CELLS[0]) for i in range(50)]
    kept = SA.contenders(pool(spark, rows), 12, 2, 2, "5")
    assert kept.where("_able").groupBy("channel_id").count().agg(F.max("count")).first()[0] <= 2
    main, spare = drawn(SA.stratified_draw(pool(spark, rows), 12, 2, 2, "5"))
    assert len(main) == 1 and len(spare) == 2


def test_published_weight(spark):
    sample = pool(spark, [("c", c) for c in CELLS for _ in range(33)])
    cands = pool(spark, [("c", CELLS[0])] * 109 + [("c", CELLS[1])] * 1445)
    got = {(r.formato, r.duracion): r for r in SA.audit(sample, cands).collect()}
    assert got[CELLS[0]].peso_reponderacion == 0.8417 and got[CELLS[0]].n_candidatos == 109
    empty = {(r.formato, r.duracion): r.peso_reponderacion for r in SA.audit(pool(spark, [("c", CELLS[0])]), cands).collect()}
    assert empty[CELLS[1]] is None


def test_refill_takes_what_is_missing(spark):
    state = spark.createDataFrame([(*CELLS[0], 3), (*CELLS[1], 0), (*CELLS[2], 5)], "stratum_format string, stratum_duration string, faltan int")
    reserve = pool(spark, [("c", CELLS[0])] * 10 + [("c", CELLS[1])] * 10 + [("c", CELLS[2])] * 4)
    stored = spark.createDataFrame([("v20",)], "external_id string")
    got = SA.refill(state, reserve, stored, 33, "1")
    assert Counter((r.stratum_format, r.stratum_duration) for r in got.collect()) == {CELLS[0]: 3, CELLS[2]: 3}
    assert [(r.repuestos, r.sin_cubrir) for r in SA.uncovered(state, got).orderBy("stratum_duration").collect()] == [(3, 0), (3, 2)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_of_a_hot_group(spark, k):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), "id",
                                  F.md5(F.col("id").cast("string")).alias("o"))
    got = {(r.g, r.id, r.rank) for r in SK.top_per_group(df, ["g"], [F.col("o")], k, F.col("id")).select("g", "id", "rank").collect()}
    want = set()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.o, r.id))
    for g, rows in groups.items():
        want |= {(g, i, n + 1) for n, (_, i) in enumerate(sorted(rows)[:k])}
    assert got == want


def test_salted_join_equals_a_plain_join(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    look = spark.range(45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how, per_task in (("inner", 100), ("left", 100), ("left", 10**6)):
        a = SK.salted_join(rows, look, "k", "id", how, per_task).select("id", "k", "v")
        b = rows.join(look, "k", how).select("id", "k", "v")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_previous_in_time_crosses_periods_and_keeps_viewers_apart(spark):
    rows = [(1, 1, "2026-01-01 23:50:00"), (2, 1, "2026-01-02 00:19:59"), (3, 2, "2026-01-01 23:55:00"), (4, 1, "2026-01-05 10:00:00"),
            (5, 1, "2026-01-05 10:30:00"), (6, 1, None)]
    from contentgauge.operators.diet import bursts, gaps

    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("watched_at", F.to_timestamp("t"))
    got = {r.event_id: (r.dieta_gap_min and round(r.dieta_gap_min, 2), r.dieta_en_rafaga) for r in gaps(df).collect()}
    assert got[1] == (None, 0) and got[2] == (29.98, 1) and got[3] == (None, 0) and got[5] == (30.0, 0) and got[6] == (None, 0)
    runs = sorted((r.user_id, r.rafaga, r.videos) for r in bursts(df.where("t is not null")).collect())
    assert runs == [(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 1, 1)]


def test_paris_time_follows_summer_time(spark):
    from contentgauge.operators.diet import local_time

    stamps = ["2026-03-29 00:30:00", "2026-03-29 01:30:00", "2026-10-25 00:30:00", "2026-10-25 01:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    assert [r[0] for r in df.coalesce(1).select(F.hour(local_time(F.to_timestamp("s")))).collect()] == [1, 3, 2, 2]
