import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L
from contentgauge.operators import placement as P, scale as S, shuffles, skew as SK, stats as T


def hist_of(spark, values, descriptor="d", fmt="informativo"):
    df = spark.createDataFrame([(descriptor, fmt, "corto", float(v)) for v in values], "descriptor string, formato string, duracion string, value double")
    return SK.histogram(df, ["descriptor", "formato", "duracion"], "value")


@pytest.mark.parametrize("n", [2, 3, 101])
def test_grid_is_the_interpolated_quantile(spark, n):
    values = [random.Random(n).randrange(50) / 4 for _ in range(n)]
    got = hist_of(spark, values).groupBy("descriptor").agg(S.grid().alias("g")).first().g
    want = [] if n < 3 else [round(float(np.quantile(values, i / 100)), 6) for i in range(101)]
    assert got == pytest.approx(want, abs=1e-9)


def test_locate_is_bounded_and_takes_the_right_end_of_ties(spark, values):
    grid = [float(i // 2) for i in range(101)]
    cases = [-1.0, 0.0, 0.5, 50.0, 51.0, None]
    points = F.array(*[F.lit(g) for g in grid])
    got = [r[0] for r in values([(c,) for c in cases], "v double", S.locate(F.col("v"), points))]
    want = [None if c is None else float(min(100, max(0, np.searchsorted(grid, c, side="right") - 1))) for c in cases]
    assert got == want
    assert values([(1.0,)], "v double", S.locate(F.col("v"), F.array().cast("array<double>"))) == [(None,)]


def test_type_needs_over_a_third_of_zeros(spark):
    exact = hist_of(spark, [0, 1, 2], "a").unionByName(hist_of(spark, [0, 0, 1, 2, 3], "b"))
    assert {r.descriptor: r.tipo for r in S.kinds(exact).collect()} == {"a": "continuo", "b": "presencia"}


def test_block_needs_eight_values(spark):
    h = hist_of(spark, range(7), "a").unionByName(hist_of(spark, range(8), "b"))
    assert {(r.descriptor, r.scope) for r in S.reference_blocks(h).collect()} == {("b", "informativo"), ("b", "_todos")}


def rows_for(spark, groups):
    rows = [("d", i, g, float(v)) for i, (g, v) in enumerate((g, v) for g, vs in groups.items() for v in vs)]
    return spark.createDataFrame(rows, "descriptor string, id long, grupo string, value double")


def test_permutation_edges(spark):
    run = lambda groups: S.permutation_test(rows_for(spark, groups), 100, 1).first().p_permutacion
    assert run({"a": range(20), "b": range(19)}) is None                       # 39 rows
    assert run({"a": range(60)}) is None                                       # one group
    assert run({"a": range(1, 41), "b": range(101, 141)}) == 0.0               # disjoint
    assert run({"a": range(1, 41), "b": range(1, 41)}) == 1.0                  # the same


def test_shuffling_agrees_with_a_plain_test(spark):
    rng = np.random.default_rng(5)
    groups = {g: np.round(rng.normal(m, 1, n), 1) for g, m, n in (("a", 0, 40), ("b", 0.35, 50), ("c", 0, 30))}
    rows = rows_for(spark, {g: list(v + 10) for g, v in groups.items()})
    a = S.permutation_test(rows, 400, 1).first()
    values = np.concatenate([v + 10 for v in groups.values()])
    labels = np.concatenate([[g] * len(v) for g, v in groups.items()])
    stat = lambda lab: round(np.ptp([np.quantile(values[lab == g], 1 / 3) for g in groups]), 9)
    real = stat(labels)
    p = np.mean([stat(rng.permutation(labels)) >= real for _ in range(2000)])
    assert a.rango == pytest.approx(real, abs=1e-6)
    assert abs(a.p_permutacion - p) < 0.08


def test_presence_statistic_counts_who_has_it(spark):
    groups = {"a": [0] * 30 + [1] * 10, "b": [0] * 10 + [1] * 30}
    r = S.permutation_test(rows_for(spark, groups), 100, 1).first()
    assert r.tipo == "presencia" and r.rango == 0.5 and r.p_permutacion == 0.0


def scale_rows(spark, tipo="continuo", ambito="global"):
    grid = [float(i) for i in range(101)]
    rows = [(L.FRAME_VERSION, d, tipo, ambito, "global", "_todos", 100, 0.4, 60, 25.0, 50.0, 75.0, None, 0.4, grid) for d in L.PANEL]
    if ambito == "por_formato":
        rows += [(*r[:5], "informativo", *r[6:14], [g / 2 for g in r[14]]) for r in rows]
    return spark.createDataFrame(rows, """frame_version string, descriptor string, tipo string, ambito string, bloque string, scope string,
        n long, p_ausencia double, n_presentes long, p25 double, p50 double, p75 double, p_permutacion double, frac_cero double, grid array<double>""")


def wide_rows(spark, *rows):
    return spark.createDataFrame(
        [(i, fmt, "corto", 1, 600, *[v] * 8) for i, (fmt, v) in enumerate(rows)],
        "content_id long, formato string, duracion string, v_apto_panel int, duration_seconds int, " + ", ".join(f"{d} double" for d in L.PANEL))


def test_format_block_falls_back_to_all(spark):
    table = P.history_table(wide_rows(spark, ("informativo", 10.0), (None, 10.0), ("deporte_gaming", None)), scale_rows(spark, ambito="por_formato"))
    got = {r.content_id: (r.formato, r.pct_ritmo_ppm, r.est_ritmo_ppm) for r in table.collect()}
    assert got == {0: ("informativo", 20.0, "medido"), 1: ("fuera_del_marco", 10.0, "medido"), 2: ("deporte_gaming", None, "sin_dato")}


def test_presence_states(spark):
    wide = wide_rows(spark, ("informativo", 0.0), ("informativo", 3.0), ("informativo", None))
    rows = P.place(S.long_form(wide, ["content_id", "formato"]), scale_rows(spark, "presencia")).where("descriptor = 'ritmo_ppm'").collect()
    assert {(r.content_id, r.estado, r.percentil, r.n_presentes, r.p_ausencia) for r in rows} == {
        (0, "ausente", None, None, 0.4), (1, "presente", 3.0, 60, 0.4), (2, "sin_dato", None, None, None)}


def test_inversion_is_flagged_from_twelve_points(spark):
    long = spark.createDataFrame([("d", 90.0, 100.0), ("d", 10.0, 10.0), ("e", 90.0, 10.0), ("e", 10.0, 10.0)], "descriptor string, percentil double, minutos double")
    got = {r.descriptor: (r.videos_alto, round(r.cambio_alto, 2), r.inversion) for r in P.denominator_contrast(long).collect()}
    assert got == {"d": (50.0, 40.91, 1), "e": (50.0, 0.0, 0)}


def test_terciles(spark):
    cases = {"few": [1, 2, 3] * 2, "flat": [1, 2] * 6, "ok": list(range(9))}
    h = None
    for d, v in cases.items():
        h = hist_of(spark, v, d) if h is None else h.unionByName(hist_of(spark, v, d))
    got = {r.descriptor: r.cuts for r in S.terciles(h).collect()}
    assert got["few"] is None and got["flat"] is None and got["ok"] == pytest.approx([8 / 3, 16 / 3])


def test_kappa_of_the_published_table(spark):
    names = ["informativo", "practico_personal", "entretenimiento", "deporte_gaming"]
    table = [[30, 2, 5, 0], [8, 0, 5, 0], [5, 0, 14, 0], [0, 0, 1, 9]]
    pairs = [(names[i], names[j]) for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    r = T.cohen_kappa(spark.createDataFrame(pairs, "a string, b string")).first()
    assert (r.n, r.acuerdos, round(r.kappa, 3), r.lectura) == (79, 53, 0.494, "moderado")
    cross = {x.a: [x[n] for n in names] for x in T.cross_table(spark.createDataFrame(pairs, "a string, b string"), names).collect()}
    assert [cross[n] for n in names] == table


def test_kappa_edges(spark):
    none = T.cohen_kappa(spark.createDataFrame([], "a string, b string")).first()
    one = T.cohen_kappa(spark.createDataFrame([("x", "x")] * 5, "a string, b string")).first()
    perfect = T.cohen_kappa(spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")).first()
    assert none.kappa is None and one.kappa is None and one.lectura == "no calculable" and perfect.kappa == 1.0


def test_explained_variance_matches_a_plain_sum(spark):
    rng = random.Random(1)
    rows = [("d", g, rng.gauss(m, 1)) for g, m in (("a", 0), ("b", 1), ("c", 3)) for _ in range(20)]
    got = T.explained_variance(spark.createDataFrame(rows, "descriptor string, g string, value double"), "g").first().eta2
    v = np.array([r[2] for r in rows])
    groups = {g: np.array([r[2] for r in rows if r[1] == g]) for g in "abc"}
    want = sum(len(x) * (x.mean() - v.mean()) ** 2 for x in groups.values()) / ((v - v.mean()) ** 2).sum()
    assert got == pytest.approx(want, abs=1e-6)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert df.select(T.safe_corr(F.col("a"), F.col("b"))).first()[0] is None


def test_spearman_uses_average_ranks(spark):
    x, y = [1, 2, 2, 3, 9], [1, 1, 5, 7, 8]
    rows = [("d", float(a), float(b), 1.0, 2.0, "bajo", "alto") for a, b in zip(x, y)]
    r = T.calibration(spark.createDataFrame(rows, "descriptor string, x double, y double, pct_x double, pct_y double, tramo_x string, tramo_y string")).first()
    ranks = lambda v: np.array([np.mean([j + 1 for j, w in enumerate(sorted(v)) if w == u]) for u in v])
    assert r.corr_spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-6)
    assert (r.n, r.pct_cambian_de_tramo, r.desplaz_percentil_mediana) == (5, 100.0, 1.0)


def test_calibration_of_repeated_pairs(spark):
    """Moments and quantiles from counts, next to the rows themselves."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(400) < 0.5, 0.0, rng.integers(1, 30, 400) / 4)
    y = np.where(rng.random(400) < 0.8, x, rng.integers(0, 30, 400) / 4)
    px, py = np.floor(x * 13), np.floor(y * 13)
    name = lambda p: None if p > 90 else "bajo" if p <= 33 else "alto"
    rows = [("d", float(a), float(b), float(p), float(q), name(p), name(q)) for a, b, p, q in zip(x, y, px, py)]
    rows += [("flat", 3.0, float(k), 1.0, 1.0, None, "bajo") for k in range(4)] + [("d", None, 1.0, None, 1.0, None, None)]
    got = T.calibration(spark.createDataFrame(
        rows, "descriptor string, x double, y double, pct_x double, pct_y double, tramo_x string, tramo_y string")).collect()
    got = {r.descriptor: r for r in got}
    d, flat = got["d"], got["flat"]
    ranks = lambda v: (np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, side="right") + 1) / 2
    assert d.n == 400 and d.corr_pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    assert d.corr_spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-6)
    assert d.cambio_relativo_mediano == pytest.approx(np.median(np.abs(y - x)[x != 0] / x[x != 0]), abs=1e-6)
    assert d.desplaz_percentil_p90 == pytest.approx(np.quantile(np.abs(py - px), 0.9), abs=1e-6)
    both = [(name(p), name(q)) for p, q in zip(px, py) if name(p) and name(q)]
    assert d.n_comparables == len(both) and d.pct_cambian_de_tramo == pytest.approx(
        100 * sum(a != b for a, b in both) / len(both), abs=1e-6)
    assert (flat.n, flat.corr_pearson, flat.corr_spearman, flat.n_comparables, flat.pct_cambian_de_tramo) == (4, None, None, 0, None)


@pytest.mark.parametrize("per_task", [2_000_000, 7])
def test_strict_percentile_with_a_hot_value(spark, per_task):
    """Half of the items share a value; dealt over tasks or not, no row is lost or doubled."""
    values = [(k, "d", 0.0 if k % 2 else float(k % 9)) for k in range(200)] + [(200, "new", 1.0), (201, "d", None), (202, "d", 0.0)]
    hist = [("d", float(v), 3 + v) for v in range(5)]
    got = S.strict_percentile(
        spark.createDataFrame(values, "content_id long, descriptor string, value double"),
        spark.createDataFrame(hist, "descriptor string, value double, freq long"), per_task=per_task).collect()
    want = {k: None if d == "new" or v is None else round(100 * sum(f for _, w, f in hist if w < v) / 25, 1) for k, d, v in values}
    assert len(got) == len(values) and {r.content_id: r.percentil for r in got} == want


@pytest.mark.parametrize("width", [5.0, 0.01])
def test_selection_equals_sorting(spark, monkeypatch, width):
    """Shuffled ranges next to sorting every shuffle; windows that miss are made wider."""
    monkeypatch.setattr(shuffles, "WIDTH", width)
    monkeypatch.setattr(shuffles, "HELD", 300)
    rng = np.random.default_rng(3)
    values = {"a": [(k, round(float(rng.normal()), 1)) for k in range(120)], "b": [(k, round(float(rng.normal()), 2)) for k in range(120)],
              "c": [(k, float(rng.integers(0, 3) - 1)) for k in range(20, 120)], "d": [(k, 1.5) for k in range(0, 120, 2)]}
    tested = [shuffles.Tested("a", False, (30, 50, 40)), shuffles.Tested("b", False, (30, 50, 40)),
              shuffles.Tested("c", True, (60, 40)), shuffles.Tested("d", False, (1, 59))]
    rows = [(d, k, v) for d, pairs in values.items() for k, v in pairs] + [("c", 3, None), ("z", 1, 2.0)]
    got = shuffles.shuffled_ranges(spark.createDataFrame(rows, "descriptor string, id long, value double"), tested, 70, 9)
    got = {(r.descriptor, r.perm): r.rango for r in got.collect()}
    assert len(got) == 4 * 70
    for t in tested:
        for perm in range(70):
            order = sorted(values[t.name], key=lambda x: md5(f"{x[0]}:{perm}:9".encode()).hexdigest())
            stats, at = [], 0
            for m in t.sizes:
                part, at = [v for _, v in order[at:at + m]], at + m
                stats.append(sum(v > 0 for v in part) / m if t.presence else float(np.quantile(part, 1 / 3)))
            assert got[t.name, perm] == pytest.approx(max(stats) - min(stats), abs=2e-9)


def test_rows_that_share_a_value_are_counted_not_held():
    """Two fifths of the rows are zero, and so is every group's cut: a task holds no more keys than the window is wide."""
    rng = np.random.default_rng(4)
    n, perms, sizes = 2000, 12, (800, 1200)
    values = np.where(np.arange(n) % 5 < 2, 0.0, np.round(rng.random(n) + 0.01, 3))
    plan = shuffles.Plan((shuffles.Tested("a", False, sizes),), (0,), perms, 9, 1.0 / 3.0)
    ids = [str(k) for k in range(n)]
    high, low = plan.keys(ids)
    order = np.array([np.lexsort((low[:, p], high[:, p])) for p in range(perms)])
    last = order[:, sizes[0] - 1]
    borders = np.stack([high[last, range(perms)], low[last, range(perms)]], axis=1)[None]
    error = [shuffles._error(1 / 3, m, 5.0) for m in sizes]
    windows = [(float(np.quantile(values, 1 / 3 - e, method="lower")), float(np.quantile(values, 1 / 3 + e, method="higher"))) for e in error]

    class Plain:  # keeps the two steps instead of running them
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, name):
            return self

        def applyInArrow(self, select, schema):
            self.select = select
            return self

    steps = shuffles._ranges(Plain(), plan, borders, windows, 5.0)
    parts = list(steps.run(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values)], ["id", "v0"])])))
    rows = pa.Table.from_batches(parts)
    held = sum(len(x.as_py()) // 8 for x in rows.column("codes"))
    assert held <= sum(2 * e * m for e, m in zip(error, sizes)) * perms
    got = {}
    for block in set(rows.column("block").to_pylist()):
        found = steps.select((pa.scalar(block),), rows.filter(pc.equal(rows.column("block"), block)))
        got |= dict(zip(found.column("perm").to_pylist(), found.column("rango").to_pylist(), strict=True))
    for p in range(perms):
        cuts = [np.quantile(values[part], 1 / 3) for part in np.split(order[p], [sizes[0]])]
        assert got[p] == pytest.approx(abs(cuts[0] - cuts[1]), abs=2e-9)
