"""Registered queries: reference scale, placement, validation (K), with the history on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L
from contentgauge.operators import placement as P, scale as S, stats as T
from contentgauge.plans import sql_features as Q, views as V
from contentgauge.operators.skew import histogram
from contentgauge.plans.common import described, reference_histogram, reference_rows, reference_scale, tested
from contentgauge.plans.registry import query
from contentgauge.plans.sql_features import rounded, text
from contentgauge.session import cut_lineage

GRID_SQL = "[" + ", ".join(f"{i}e0/1e2" for i in range(101)) + "]"
PERMS, SEED = L.PERMUTATIONS, 20260812

KINDS = Q.LONG + """,
ref as materialized (select * from long where corpus = 'referencia' and apt),
kinds as materialized (select descriptor, count(value)::bigint as n, avg((value = 0)::int::double) as frac_cero,
  case when avg((value = 0)::int::double) > 1e0/3e0 then 'presencia' else 'continuo' end as tipo
  from ref where value is not null group by descriptor)"""


def _block(keys: str, scope: str, where: str = "true") -> str:
    q = lambda p, c="value": rounded(f"quantile_cont({c}, {p})", 4)
    pos = "case when value > 0 then value end"
    return f"""select descriptor, {scope} as scope, count(*)::bigint as n, count(*) filter (value > 0)::bigint as n_presentes,
  {rounded("avg((value = 0)::int::double)", 4)} as p_ausencia, {q('25e-2')} as p25, {q('5e-1')} as p50, {q('75e-2')} as p75,
  {q('5e-1', pos)} as mediana_presentes,
  case when count(*) >= 3 then list_transform(quantile_cont(value, {GRID_SQL}), lambda g: {rounded('g', 6)}) else [] end as grid,
  case when count(*) filter (value > 0) >= 3 then list_transform(quantile_cont({pos}, {GRID_SQL}), lambda g: {rounded('g', 6)}) else [] end as grid_presentes
  from ref where value is not null and {where} group by {keys} having count(*) >= 8"""


PERMUTED = KINDS + f""",
labelled as materialized (select descriptor, content_id as id, formato as grupo, value from ref where value is not null and formato is not null),
sizes as (select descriptor, grupo, count(*) as m from labelled group by all),
ends as (select descriptor, list(e order by grupo) as ends, sum(m) as n, count(*) as g from (
  select *, sum(m) over (partition by descriptor order by grupo) as e from sizes) group by descriptor),
real_stat as (select descriptor, round_even((max(s) - min(s)) * 1e9, 0)::double / 1e9 as rango from (
  select l.descriptor, grupo, case when any_value(k.tipo) = 'presencia' then avg((value > 0)::int::double) else quantile_cont(value, 1e0/3e0) end as s
  from labelled l join kinds k using (descriptor) group by l.descriptor, grupo) group by descriptor),
shuffled as (select descriptor, perm, value, row_number() over (partition by descriptor, perm order by md5(id || ':' || perm || ':{SEED}'), id) as at
  from labelled, range(0, {PERMS}) t(perm)),
null_stat as (select descriptor, perm, round_even((max(s) - min(s)) * 1e9, 0)::double / 1e9 as rango from (
  select s.descriptor, perm, len(list_filter(e.ends, lambda x: x < s.at)) as g,
   case when any_value(k.tipo) = 'presencia' then avg((value > 0)::int::double) else quantile_cont(value, 1e0/3e0) end as s
  from shuffled s join ends e using (descriptor) join kinds k using (descriptor) where e.n >= 40 and e.g >= 2 group by all) group by all),
tested as (select k.descriptor, k.tipo, k.n, r.rango, {rounded('avg((x.rango >= r.rango)::int::double)', 4)} as p_permutacion
  from kinds k left join real_stat r using (descriptor) left join null_stat x using (descriptor) group by k.descriptor, k.tipo, k.n, r.rango)"""


BLOCKS = PERMUTED + f""",
blocks as materialized ({_block('descriptor', "'_todos'")} union all {_block('descriptor, formato', 'formato', 'formato is not null')}),
scale as materialized (
 select b.descriptor, k.tipo, case when t.p_permutacion < 0.05 then 'por_formato' else 'global' end as ambito, scope, b.n,
  case when k.tipo = 'presencia' then p_ausencia end as p_ausencia, case when k.tipo = 'presencia' then n_presentes end as n_presentes,
  case when k.tipo <> 'presencia' then p25 end as p25, case when k.tipo = 'presencia' then mediana_presentes else p50 end as p50,
  case when k.tipo <> 'presencia' then p75 end as p75, {rounded('frac_cero', 4)} as frac_cero,
  case when k.tipo = 'presencia' then grid_presentes else grid end as grid, t.p_permutacion
 from blocks b join kinds k using (descriptor) join tested t using (descriptor) where t.p_permutacion < 0.05 or scope = '_todos')"""

PLACED = BLOCKS + """,
hist_rows as materialized (select * from long where corpus = 'historial' and apt),
placed as materialized (
 select *, case when not known then 'sin_dato' when tipo <> 'presencia' then 'medido' when value > 0 then 'presente' else 'ausente' end as estado,
  case when known and (tipo <> 'presencia' or value > 0) and len(grid) > 0 then
   least(100, greatest(0, len(list_filter(grid, lambda g: g <= value)) - 1))::double end as percentil
 from (select h.content_id, h.formato, h.duracion, h.duration_seconds, h.descriptor, h.value, a.tipo, a.ambito,
   coalesce(o.grid, a.grid) as grid, coalesce(o.p_ausencia, a.p_ausencia) as p_ausencia,
   coalesce(o.n_presentes, a.n_presentes) as n_presentes, coalesce(o.p50, a.p50) as p50,
   h.value is not null and a.n is not null as known
  from hist_rows h left join scale a on a.descriptor = h.descriptor and a.scope = '_todos'
  left join scale o on o.descriptor = h.descriptor and o.scope = h.formato)),
table_rows as materialized (select content_id, coalesce(formato, 'fuera_del_marco') as formato, coalesce(duracion, 'fuera_del_marco') as duracion,
  round_even(coalesce(duration_seconds, 0) / 60e0 * 1e1, 0)::double / 1e1 as minutos, descriptor, value, percentil, estado from placed)"""


def history(spark, sf):
    return P.history_table(described(spark, sf, "historial"), reference_scale(spark, sf))


@query("entry_history_on_scale", f"""select descriptor, {rounded('quantile_cont(percentil, 5e-1)', 6)} as mediana_percentil,
  {rounded('quantile_cont(value, 5e-1)', 6)} as mediana_valor, any_value(p50) as mediana_corpus
  from (select t.*, s.p50 from table_rows t left join scale s on s.descriptor = t.descriptor and s.scope = '_todos')
  where value is not null group by descriptor""", PLACED)
def entry(spark, sf):
    """Flagship: the watched items against the reference corpus."""
    scale = reference_scale(spark, sf)
    table = P.history_table(described(spark, sf, "historial"), scale)
    medians = P.history_medians(P.history_long(table))
    corpus = scale.where(F.col("scope") == S.ALL).select("descriptor", F.col("p50").alias("mediana_corpus"))
    return medians.join(F.broadcast(corpus), "descriptor", "left").select(
        "descriptor", F.round("mediana_percentil", 6).alias("mediana_percentil"),
        F.round("mediana_valor", 6).alias("mediana_valor"), "mediana_corpus")


@query("k01_percentile_grid", f"""select descriptor, (i - 1)::int as p, grid[i] as v from (
  select descriptor, list_transform(quantile_cont(value, {GRID_SQL}), lambda g: {rounded('g', 6)}) as grid
  from ref where value is not null group by descriptor having count(*) >= 3), range(1, 102) t(i)""", KINDS)
def k01(spark, sf):
    hist = reference_histogram(spark, sf)
    return hist.groupBy("descriptor").agg(S.grid().alias("g")).select("descriptor", F.posexplode("g").alias("p", "v"))


@query("k02_grid_location", "select content_id, descriptor, percentil, estado from placed", PLACED)
def k02(spark, sf):
    scale = reference_scale(spark, sf)
    rows = S.long_form(described(spark, sf, "historial").where("v_apto_panel = 1"), ["content_id", "formato"])
    return P.place(rows, scale).select("content_id", "descriptor", "percentil", "estado")


@query("k03_strict_percentile", f"""select h.content_id, h.descriptor, {rounded("1e2 * (select count(*) filter (r.value < h.value) / count(*)::double from ref r where r.descriptor = h.descriptor and r.value is not null)", 1)} as percentil
  from long h where h.corpus = 'historial' and h.apt and h.value is not null""", KINDS)
def k03(spark, sf):
    rows = S.long_form(described(spark, sf, "historial").where("v_apto_panel = 1"), ["content_id"])
    hist = reference_histogram(spark, sf)
    return S.strict_percentile(cut_lineage(rows.where("value is not null")), hist).select("content_id", "descriptor", "percentil")


CUTS = KINDS + """,
apt_rows as (select * from feat where apt and corpus = 'referencia'),
cell_n as (select formato, duracion, count(*)::bigint as n from apt_rows group by all),
spine as (select f as formato, d as duracion, descriptor from (select unnest(['informativo','practico_personal','entretenimiento','deporte_gaming']) as f),
  (select unnest(['corto','medio','largo']) as d), (select distinct descriptor from ref)),
%s,
cuts as (select s.formato, s.duracion, s.descriptor, coalesce(c.n, 0)::bigint as n_util,
  case when coalesce(c.n, 0) >= 15 then o.cut end as own, g.cut as overall from spine s
  left join cell_n c on c.formato = s.formato and c.duracion = s.duracion
  left join own o on o.formato = s.formato and o.duracion = s.duracion and o.descriptor = s.descriptor
  left join overall g on g.descriptor = s.descriptor)""" % ",\n".join(
    f"""{name} as (select {keys}, struct_pack(p33 := {rounded('quantile_cont(value, 1e0/3e0)', 4)}, p50 := {rounded('median(value)', 4)},
  p67 := {rounded('quantile_cont(value, 2e0/3e0)', 4)}, mn := {rounded('min(value)', 4)}, mx := {rounded('max(value)', 4)}) as cut
  from ref where value is not null group by {keys} having count(*) >= 3 and count(distinct value) >= 3)"""
    for name, keys in (("own", "descriptor, formato, duracion"), ("overall", "descriptor")))


@query("k04_tercile_place", """select h.content_id, h.descriptor, case when h.value is null or coalesce(c.own, c.overall) is null then 'sin_dato'
  when h.value <= coalesce(c.own, c.overall).p33 then 'bajo' when h.value <= coalesce(c.own, c.overall).p67 then 'medio' else 'alto' end as tramo
  from long h left join cuts c on c.formato = h.formato and c.duracion = h.duracion and c.descriptor = h.descriptor
  where h.corpus = 'historial' and h.apt""", CUTS)
def k04(spark, sf):
    rows = S.long_form(described(spark, sf, "historial").where("v_apto_panel = 1"), ["content_id", "formato", "duracion"])
    cuts = _cell_cuts(spark, sf).select("formato", "duracion", "descriptor", "p33", "p67")
    placed = rows.join(F.broadcast(cuts), ["formato", "duracion", "descriptor"], "left")
    return placed.select("content_id", "descriptor", S.tercile_place(F.col("value"), F.col("p33"), F.col("p67")).alias("tramo"))


def _cell_cuts(spark, sf):
    """Cuts per cell; values and sizes of the cells from one reading of the texts."""
    rows = reference_rows(spark, sf).withColumnRenamed("grupo", "formato")
    sizes = S.cell_sizes(rows.where(F.col("descriptor") == next(iter(L.PANEL))))
    return S.cell_cuts(histogram(rows, ["descriptor", "formato", "duracion"], "value"), cell_rows=sizes)


@query("k05_descriptor_type", f"select descriptor, n, {rounded('frac_cero', 6)} as frac_cero, tipo from kinds", KINDS)
def k05(spark, sf):
    return S.kinds(reference_histogram(spark, sf)).select(
        "descriptor", "n", S.half_even(F.col("frac_cero"), 6).alias("frac_cero"), "tipo")


@query("k06_permutation_test", "select descriptor, tipo, n, rango, p_permutacion from tested", PERMUTED)
def k06(spark, sf):
    return tested(spark, sf).select("descriptor", "tipo", "n", "rango", "p_permutacion")


@query("k07_scope", "select descriptor, tipo, case when p_permutacion < 0.05 then 'por_formato' else 'global' end as ambito from tested", PERMUTED)
def k07(spark, sf):
    return tested(spark, sf).select("descriptor", "tipo", "ambito")


BLOCK_COLUMNS = "descriptor, scope, n, n_presentes, p_ausencia, p25, p50, p75, mediana_presentes"


@query("k08_reference_blocks", f"""select {BLOCK_COLUMNS}, len(grid)::bigint as puntos, len(grid_presentes)::bigint as puntos_presentes,
  {rounded('list_sum(grid)', 4)} as suma, {rounded('list_sum(grid_presentes)', 4)} as suma_presentes from blocks""", BLOCKS)
def k08(spark, sf):
    total = lambda c: F.when(F.size(c) > 0, S.half_even(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4))
    return S.reference_blocks(reference_histogram(spark, sf)).select(
        *BLOCK_COLUMNS.split(", "), F.size("grid").cast("long").alias("puntos"),
        F.size("grid_presentes").cast("long").alias("puntos_presentes"), total("grid").alias("suma"),
        total("grid_presentes").alias("suma_presentes"))


@query("k09_scale", f"select {text(L.FRAME_VERSION)} as frame_version, descriptor, tipo, ambito, scope, n, p_ausencia, n_presentes, p25, p50, p75, p_permutacion, frac_cero from scale", BLOCKS)
def k09(spark, sf):
    return reference_scale(spark, sf).drop("grid", "bloque")


@query("k09b_scale_corpus", f"""select {text(L.FRAME_VERSION)} as frame_version, count(*)::bigint as n_filas,
  count(*) filter (n > 0)::bigint as n_con_transcripcion, count(*) filter (apt)::bigint as n_apto_panel from gate where corpus = 'referencia'""", Q.TOKENS)
def k09b(spark, sf):
    return described(spark, sf, "referencia").agg(
        F.lit(L.FRAME_VERSION).alias("frame_version"), F.count(F.lit(1)).alias("n_filas"),
        F.sum("v_tiene_transcripcion").alias("n_con_transcripcion"), F.sum("v_apto_panel").alias("n_apto_panel"))


@query("k10_cell_cuts", f"""select {text(L.FRAME_VERSION)} as frame_version, formato, duracion, descriptor, n_util, coalesce(own, overall).p33 as p33,
  coalesce(own, overall).p50 as p50, coalesce(own, overall).p67 as p67, coalesce(own, overall).mn as min, coalesce(own, overall).mx as max,
  own is null as fallback_global from cuts where coalesce(own, overall) is not null""", CUTS)
def k10(spark, sf):
    return _cell_cuts(spark, sf)


@query("k10b_uncut_cells", """select coalesce(formato || '/' || duracion, 'GLOBAL') as donde, descriptor,
  case when n < 3 then 'pocos_valores' else 'pocos_distintos' end as motivo, case when n < 3 then n else d end::bigint as cuantos from (
  select formato, duracion, descriptor, count(*) as n, count(distinct value) as d from ref where value is not null and formato is not null and duracion is not null group by all
  union all select null, null, descriptor, count(*), count(distinct value) from ref where value is not null group by descriptor)
  where n < 3 or d < 3""", KINDS)
def k10b(spark, sf):
    return S.uncut(reference_histogram(spark, sf))


def _ref_long(spark, sf, *keys):
    return S.long_form(described(spark, sf, "referencia").where("v_apto_panel = 1"), list(keys))


@query("k11_explained_variance", """select descriptor, case when count(*) >= 12 and count(distinct value) >= 3 then
   round(sum((m - t) ** 2) / nullif(sum((value - t) ** 2), 0), 6) end as eta2
  from (select *, avg(value) over (partition by descriptor) as t, avg(value) over (partition by descriptor, formato) as m
    from ref where value is not null and formato is not null) group by descriptor""", KINDS)
def k11(spark, sf):
    return T.explained_variance(_ref_long(spark, sf, "formato"), "formato")


@query("k12_duration_correlation", """select descriptor, count(value)::bigint as n, round(nullif(corr(value, ln(duration_seconds::double)), 'nan'::double), 6) as corr_log_dur_global
  from ref where duration_seconds > 0 group by descriptor""", KINDS)
def k12(spark, sf):
    return T.duration_correlation(_ref_long(spark, sf, "duration_seconds"))


@query("k13_cell_correlation", """select descriptor, count(*)::bigint as celdas, round(arg_max(r, abs(r)), 6) as corr_log_dur_intra_max,
  round(avg(r), 6) as corr_log_dur_intra_media from (select descriptor, formato, duracion, corr(value, ln(duration_seconds::double)) as r
   from ref where formato is not null and duracion is not null and duration_seconds > 0 group by all
   having count(value) >= 8 and count(distinct value) > 2) where not isnan(r) group by descriptor""", KINDS)
def k13(spark, sf):
    return T.duration_correlation_in_cells(_ref_long(spark, sf, "formato", "duracion", "duration_seconds"))


PAIRS = [(a, b) for i, a in enumerate(L.PANEL) for b in L.PANEL[i + 1:]]
MATRIX_SQL = " union all ".join(
    f"select {text(a)} as a, {text(b)} as b, round(nullif(corr({a}::double, {b}::double), 'nan'::double), 6) as r from feat where apt and corpus = 'referencia'" for a, b in PAIRS)


@query("k14_correlation_matrix", MATRIX_SQL, Q.PANEL)
def k14(spark, sf):
    return T.correlation_matrix(described(spark, sf, "referencia").where("v_apto_panel = 1"))


@query("f04_strongest_pairs", f"select * from ({MATRIX_SQL}) where r is not null order by abs(r) desc, a, b limit 5", Q.PANEL)
def f04(spark, sf):
    return T.strongest_pairs(T.correlation_matrix(described(spark, sf, "referencia").where("v_apto_panel = 1")))


@query("k15_c06_panel_placement", """select content_id, descriptor, tipo, ambito, estado, value, percentil,
  case when known and tipo = 'presencia' then p_ausencia end as p_ausencia,
  case when known and tipo = 'presencia' and value > 0 then n_presentes end as n_presentes,
  case when known and tipo <> 'presencia' then p50 end as mediana_corpus from placed""", PLACED)
def k15(spark, sf):
    rows = P.panel_rows(described(spark, sf, "historial").where("v_apto_panel = 1"), reference_scale(spark, sf))
    e = rows.select("content_id", F.explode("panel").alias("e"))
    return e.select("content_id", F.col("e.clave").alias("descriptor"), "e.tipo", "e.ambito", "e.estado",
                    F.col("e.valor").alias("value"), "e.percentil", "e.p_ausencia", "e.n_presentes", "e.mediana_corpus")


@query("k16_history_table", "select content_id, any_value(formato) as formato, any_value(duracion) as duracion, any_value(minutos) as minutos, "
       + ", ".join(f"max(percentil) filter (descriptor = '{d}') as pct_{d}, max(estado) filter (descriptor = '{d}') as est_{d}" for d in L.PANEL)
       + " from table_rows group by content_id", PLACED)
def k16(spark, sf):
    return history(spark, sf).drop(*L.PANEL)


@query("k17_gold_rows", """select g.content_id as content_item_id, 'panel-1.0' as features_version, g.formato, g.apt as apto,
  case when n = 0 then 'sin_transcripcion' when not complete then 'transcripcion_incompleta' when category_id is null then 'sin_metadatos' end as motivo_no_apto,
  nullif(len(list_filter(regexp_split_to_array(trim(transcript, E' \\t\\n\\r'), '\\s+'), lambda w: w <> '')), 0)::bigint as n_words, lang,
  coalesce(trim(description), '') <> '' as has_description, p.ritmo_ppm_pct, p.mattr_200_pct
  from gate g left join (select content_id, max(percentil) filter (descriptor = 'ritmo_ppm') as ritmo_ppm_pct,
   max(percentil) filter (descriptor = 'mattr_200') as mattr_200_pct from placed group by content_id) p using (content_id)
  where corpus = 'historial'""", PLACED)
def k17(spark, sf):
    placed = P.panel_rows(described(spark, sf, "historial"), reference_scale(spark, sf))
    gold = P.gold_rows(placed, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return gold.select("content_item_id", "features_version", "formato", "apto", "motivo_no_apto",
                       F.col("n_words").cast("long").alias("n_words"), "lang", "has_description", "ritmo_ppm_pct", "mattr_200_pct")


@query("k18_frame_guard", """select l_orderkey % 3 as frame, count(*)::bigint as rows_kept from lineitem where l_orderkey % 3 = 1 group by 1""")
def k18(spark, sf):
    gold = V.table(spark, sf, "lineitem").withColumn("frame_version", (F.col("l_orderkey") % 3).cast("string"))
    return P.same_frame(gold, "1").groupBy((F.col("l_orderkey") % 3).alias("frame")).agg(F.count(F.lit(1)).alias("rows_kept"))


# two instruments: the panel of an item as it is and of the same text read with the other lists
CALIBRATED = PLACED + """,
second as (select content_id, descriptor, value * (1e0 + (content_id % 7 - 3) / 1e2) as value from hist_rows),
pairs as materialized (select p.descriptor, p.value as x, round_even(s.value * 1e4, 0)::double / 1e4 as y, p.grid, p.percentil as pct_x, p.tipo
  from placed p join second s using (content_id, descriptor)),
both_sides as materialized (select descriptor, x, y, pct_x, pct_y, case when pct_x <= 33 then 'bajo' when pct_x <= 67 then 'medio' when pct_x <= 100 then 'alto' end as tx,
  case when pct_y <= 33 then 'bajo' when pct_y <= 67 then 'medio' when pct_y <= 100 then 'alto' end as ty
  from (select *, case when y is not null and (tipo <> 'presencia' or y > 0) and len(grid) > 0 then
   least(100, greatest(0, len(list_filter(grid, lambda g: g <= y)) - 1))::double end as pct_y from pairs) where x is not null and y is not null),
ranked as (select *, rank() over (partition by descriptor order by x) + (count(*) over (partition by descriptor, x) - 1) / 2e0 as rx,
  rank() over (partition by descriptor order by y) + (count(*) over (partition by descriptor, y) - 1) / 2e0 as ry from both_sides)"""


@query("k19_c10_instrument_calibration", f"""select descriptor, count(*)::bigint as n, round(nullif(corr(x, y), 'nan'::double), 6) as corr_pearson, round(nullif(corr(rx, ry), 'nan'::double), 6) as corr_spearman,
  {rounded("quantile_cont(case when x <> 0 then round_even(abs((y - x) / x) * 1e6, 0)::double / 1e6 end, 5e-1)", 6)} as cambio_relativo_mediano,
  {rounded('quantile_cont(abs(pct_y - pct_x), 5e-1)', 6)} as desplaz_percentil_mediana, {rounded('quantile_cont(abs(pct_y - pct_x), 9e-1)', 6)} as desplaz_percentil_p90,
  count(*) filter (tx is not null and ty is not null)::bigint as n_comparables,
  {rounded('1e2 * count(*) filter (tx <> ty) / nullif(count(*) filter (tx is not null and ty is not null), 0)', 6)} as pct_cambian_de_tramo
  from ranked group by descriptor""", CALIBRATED)
def k19(spark, sf):
    scale = reference_scale(spark, sf)
    rows = S.long_form(described(spark, sf, "historial").where("v_apto_panel = 1"), ["content_id", "formato"])
    second = rows.withColumn("value", S.half_even(
        F.col("value") * (1.0 + (F.col("content_id") % 7 - 3).cast("double") / 100.0), 4))
    keys = ["content_id", "descriptor"]
    x = P.place(rows, scale).select(*keys, F.col("value").alias("x"), F.col("percentil").alias("pct_x"))
    y = P.place(second, scale).select(*keys, F.col("value").alias("y"), F.col("percentil").alias("pct_y"))
    pairs = x.join(y, keys).withColumns({"tramo_x": P.tramo(F.col("pct_x")), "tramo_y": P.tramo(F.col("pct_y"))})
    return T.calibration(pairs)


# ------------------------------------------------------------------ the history report


@query("d11_minutes_by_format", f"""select formato, count(*)::bigint as videos, {rounded('sum(minutos)', 6)} as minutos,
  {rounded('1e2 * sum(minutos) / (select sum(minutos) from table_rows where descriptor = ' + "'ritmo_ppm')", 6)} as pct_minutos
  from table_rows where descriptor = 'ritmo_ppm' group by formato""", PLACED)
def d11(spark, sf):
    table = described(spark, sf, "historial").where("v_apto_panel = 1").select(
        F.coalesce("formato", F.lit(P.OUT_OF_FRAME)).alias("formato"),
        P.half_even(F.coalesce("duration_seconds", F.lit(0)) / 60.0, 1).alias("minutos"))
    return P.minutes_by_format(table)


@query("d11b_top_stratum", f"""select formato, duracion, minutos, {rounded('1e2 * minutos / total', 6)} as pct_total from (
  select *, sum(minutos) over () as total from (select formato, duracion, {rounded('sum(minutos)', 6)} as minutos from table_rows where descriptor = 'ritmo_ppm' group by all))
  order by minutos desc, formato desc, duracion desc limit 1""", PLACED)
def d11b(spark, sf):
    table = described(spark, sf, "historial").where("v_apto_panel = 1").select(
        F.coalesce("formato", F.lit(P.OUT_OF_FRAME)).alias("formato"), F.coalesce("duracion", F.lit(P.OUT_OF_FRAME)).alias("duracion"),
        P.half_even(F.coalesce("duration_seconds", F.lit(0)) / 60.0, 1).alias("minutos"))
    return P.top_stratum(table)


CONTRAST_SQL = "select descriptor, " + ", ".join(
    f"{rounded(f'1e2 * count(*) filter (t = {text(x)}) / count(*)', 6)} as videos_{x}, {rounded(f'1e2 * coalesce(sum(minutos) filter (t = {text(x)}), 0) / sum(minutos)', 6)} as minutos_{x}"
    for x in ("bajo", "medio", "alto")) + """ from (select *, case when percentil <= 33 then 'bajo' when percentil <= 67 then 'medio' else 'alto' end as t
  from table_rows where percentil is not null) group by descriptor"""


@query("d12_denominator_contrast", f"""select *, {rounded('minutos_alto - videos_alto', 6)} as cambio_alto,
  (abs({rounded('minutos_alto - videos_alto', 6)}) >= 12)::int as inversion from ({CONTRAST_SQL})""", PLACED)
def d12(spark, sf):
    return P.denominator_contrast(P.history_long(history(spark, sf)))


@query("d14_presence_contrast", f"""select t.descriptor, {rounded("avg((estado = 'presente')::int::double)", 6)} as tuyos,
  {rounded('1e0 - any_value(s.p_ausencia)', 6)} as corpus, quantile_cont(percentil, 5e-1) as mediana_percentil
  from table_rows t join scale s on s.descriptor = t.descriptor and s.scope = '_todos' and s.tipo = 'presencia' group by t.descriptor""", PLACED)
def d14(spark, sf):
    scale = reference_scale(spark, sf)
    return P.presence_contrast(P.history_long(P.history_table(described(spark, sf, "historial"), scale)), scale)


@query("d13_screening_by_format", f"""select coalesce(formato, 'fuera_del_marco') as formato, count(*) filter (n > 0)::bigint as con_texto,
  count(*) filter (apt)::bigint as aptos, (count(*) filter (n > 0) - count(*) filter (apt))::bigint as cribados,
  {rounded('1e2 * (count(*) filter (n > 0) - count(*) filter (apt)) / greatest(count(*) filter (n > 0), 1)', 6)} as pct
  from gate where corpus = 'referencia' group by 1""", Q.TOKENS)
def d13(spark, sf):
    t, a = F.sum("v_tiene_transcripcion"), F.sum("v_apto_panel")
    return described(spark, sf, "referencia").groupBy(F.coalesce("formato", F.lit(P.OUT_OF_FRAME)).alias("formato")).agg(
        t.alias("con_texto"), a.alias("aptos"), (t - a).alias("cribados"),
        S.half_even(100.0 * (t - a) / F.greatest(t, F.lit(1)), 6).alias("pct"))


@query("b09_cache_split", """select content_id, case when content_id % 5 <> 0 and content_id % 3 <> 0 and content_id % 4 <> 0 and not content_id % 7 = 0 then 'hit' else 'miss' end as plan from content_v""")
def b09(spark, sf):
    """Stored panels: frame, version, panel and transcript age decide."""
    c = V.content(spark, sf).select(F.col("content_id").alias("id"))
    i = F.col("id")
    day = lambda c: F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(c)
    items = c.withColumn("transcript_fetched_at", F.when(i % 2 == 0, day(F.when(i % 7 == 0, 9).otherwise(1))).otherwise(
        F.when(i % 7 == 0, day(F.lit(9)))))
    gold = c.select(
        i.alias("content_item_id"), F.when(i % 5 == 0, "old").otherwise(L.FRAME_VERSION).alias("frame_version"),
        F.when(i % 3 == 0, "1.0").otherwise(L.PANEL_VERSION).alias("features_version"),
        F.when(i % 4 == 0, None).otherwise("[]").alias("panel"), day(F.lit(2)).alias("computed_at"))
    hits, misses = P.split_by_freshness(items, gold)
    return hits.select(F.col("content_item_id").alias("content_id"), F.lit("hit").alias("plan")).unionByName(
        misses.select(F.col("id").alias("content_id"), F.lit("miss").alias("plan")))


@query("b18_language_warning", """select doc_id, case when lang not like 'es%' then 'La transcripción está en ''' || lang || '''. La escala de referencia es de videos en español: los percentiles no son estrictamente comparables.' end as aviso_idioma from documents""")
def b18(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", P.language_warning(F.col("lang")).alias("aviso_idioma"))


PANEL_ORDER = L.PANEL


@query("a27_l07_dashboard_rows", "select content_id, any_value(formato) as formato, any_value(minutos) as minutos, "
       + ", ".join(f"round_even(max(percentil) filter (descriptor = '{d}'), 0)::int as p{i}" for i, d in enumerate(L.PANEL))
       + " from table_rows group by content_id", PLACED)
def a27(spark, sf):
    from contentgauge.sources.snapshots import dashboard_rows
    rows = P.panel_rows(described(spark, sf, "historial").where("v_apto_panel = 1"), reference_scale(spark, sf))
    rows = rows.withColumns({"watched_at": F.lit("2026-01-01 12:00:00").cast("timestamp"), "n_words": F.col("n_words"),
                             "formato": F.coalesce("formato", F.lit(P.OUT_OF_FRAME))})
    return dashboard_rows(rows, keep=["content_id"]).select("content_id", "formato", "minutos", *[f"p{i}" for i in range(8)])


@query("a28_scale_metadata", "select descriptor, tipo, ambito, scope, n, p50 from scale", BLOCKS)
def a28(spark, sf):
    return P.scale_metadata(reference_scale(spark, sf)).select("descriptor", "tipo", "ambito", "scope", "n", "p50")


@query("l08_weekly_rollup", """select strftime(date_trunc('week', w.watched_at at time zone 'UTC' at time zone 'Europe/Paris'), '%Y-%m-%d') as semana,
  t.formato, t.descriptor, round(quantile_cont(percentil, 5e-1), 6) as mediana from watch_v w join table_rows t using (content_id)
  where percentil is not null group by all""", PLACED)
def l08(spark, sf):
    from contentgauge.operators.diet import weekly_rollup
    from contentgauge.operators.skew import salted_join
    long = S.long_form(described(spark, sf, "historial").where("v_apto_panel = 1"), ["content_id", "formato"])
    placed = P.place(long, reference_scale(spark, sf)).withColumn("formato", F.coalesce("formato", F.lit(P.OUT_OF_FRAME)))
    placed = placed.groupBy("content_id", "formato").agg(F.collect_list(F.struct("descriptor", "percentil")).alias("d"))
    watched = salted_join(V.watches(spark, sf), placed, "content_id", "event_id").select("watched_at", "formato", F.inline("d"))
    return weekly_rollup(watched).select("semana", "formato", "descriptor", F.round("mediana", 6).alias("mediana"))
