import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L, strata
from contentgauge.operators import indicators as I

SCHEMA = """content_id long, transcript string, title string, description string, tags array<string>, category_id string,
 duration_seconds int, n_chapters int, transcript_is_generated boolean, transcript_lang string, video_language string"""


def item(i, transcript="", title="", description=None, tags=None, category="25", seconds=600, chapters=None, auto=False,
         lang="es", video=None):
    return (i, transcript, title, description, tags, category, seconds, chapters, auto, lang, video)


def described(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("category_name", strata.category_name(F.col("category_id")))
    return {r.content_id: r for r in I.describe(df).collect()}


def words(n):
    return " ".join(f"palabra{i}" for i in range(n))


def test_gate_thresholds(spark):
    # 1000 s are 2500 expected words
    got = described(
        spark, item(1, words(1124), seconds=1000), item(2, words(1125), seconds=1000), item(3, words(4000), seconds=1000),
        item(4, words(4001), seconds=1000), item(5, words(1500), seconds=0), item(6, words(1500), seconds=None),
        item(7, words(1500), category=None), item(8, ""), item(9, None))
    assert [got[i].v_transcripcion_completa for i in range(1, 10)] == [0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert [got[i].v_apto_panel for i in range(1, 10)] == [0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert got[8].v_tiene_transcripcion == 0 and got[8].ritmo_ppm is None and got[8].conectores_1000w is None
    assert got[5].ritmo_ppm is None and got[5].capitulos_10min is None


def test_real_lexicons_on_a_spanish_text(spark):
    text = "Porque según un estudio, el mejor dato. Quizás suscríbete: usa mi código; o sea, dos kilómetros en 1999 y 50 %."
    r = described(spark, item(1, text))[1]
    n = r.n_words
    assert n == 20
    per = lambda k: round(k / n * 1000, 2)
    assert r.conectores_1000w == per(2)          # porque, o sea
    assert r.atribucion_1000w == per(2)          # segun, un estudio
    assert r.absolutos_1000w == per(1) and r.matizadores_1000w == per(1)
    assert r.cta_1000w == per(1) and r.patrocinio_1000w == per(1)
    assert r.promocional_1000w == per(2) and r.muletillas_1000w == per(1)
    assert r.ratio_matiz_absoluto == 1.0
    assert r.cifras_100w == round(3 / n * 100, 2)   # 1999, 50, dos
    assert r.unidades_1000w == per(1) and r.anios_1000w == per(1) and r.porcentajes_1000w == per(1)


def test_english_lists_for_english_text(spark):
    got = described(spark, item(1, "because porque", lang="en"), item(2, "because porque", lang="es"))
    assert got[1].conectores_1000w == got[2].conectores_1000w == 500.0


@pytest.mark.parametrize("n", [0, 1, 199, 200, 249, 250, 1000])
def test_moving_ratio_matches_a_plain_loop(spark, n):
    rng = random.Random(n)
    toks = [f"w{rng.randrange(150)}" for _ in range(n)]
    if n == 0:
        want = None
    elif n < 200:
        want = len(set(toks)) / n
    else:
        parts = [len(set(toks[i:i + 200])) / 200 for i in range(0, n - 199, 50)]
        want = sum(parts) / len(parts)
    got = spark.createDataFrame([(toks,)], "t array<string>").select(I.moving_type_token_ratio(F.col("t"))).first()[0]
    assert got == want if want is None else abs(got - want) < 1e-12


def test_vocabulary_matches_a_plain_count(spark):
    text = "gato gato perro la de 12 12 raton 3x luna"
    r = described(spark, item(1, text))[1]
    content = ["gato", "gato", "perro", "raton", "3x", "luna"]
    c = Counter(content)
    assert r.p_palabras_contenido == 0.6
    assert r.hapax_ratio == round(sum(v == 1 for v in c.values()) / len(c), 3)


def test_title_promise(spark):
    got = described(
        spark, item(1, "luna sobre roma y luna", title="Luna roma luna"), item(2, "algo", title="de la"),
        item(3, "sol y mar", title="Luna nueva"))
    assert (got[1].titulo_palabras_clave, got[1].cobertura_titulo, got[1].foco_promesa, got[1].densidad_tema_100w) == (3, 1.0, 0.0, 60.0)
    assert got[2].titulo_palabras_clave == 0 and got[2].cobertura_titulo is None
    assert got[3].cobertura_titulo == 0.0 and got[3].foco_promesa is None and got[3].densidad_tema_100w is None


def test_title_flags(spark):
    got = described(
        spark, item(1, title="¡INCREÍBLE final!"), item(2, title="Top 10 goles"), item(3, title="123 cosas"), item(4, title="¿Por qué?"))
    assert (got[1].titulo_exclamaciones, got[1].titulo_superlativos, got[1].titulo_banderas) == (2, 1, 3)
    assert [got[i].titulo_numero_lista for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert got[4].titulo_es_pregunta == 1 and got[4].et_promesa == "pregunta" and got[2].et_promesa == "lista"


def test_editorial_form_takes_the_first_rule(spark):
    cases = [("Entrevista y resumen", None, 600, None, "25", "conversacion_larga"), ("charla", None, 2701, 3, "25", "conversacion_larga"),
             ("charla", None, 2700, 3, "25", "actualidad"), ("Resumen", None, 600, None, "25", "resumen_evento"),
             ("Cómo cocinar", None, 600, None, "25", "instructivo"), ("5 ideas", None, 600, None, "25", "lista_ranking"),
             ("x", ["stream"], 600, None, "25", "directo"), ("Análisis", None, 600, None, "25", "explicativo"),
             ("reseña", None, 600, None, "26", "sin_clasificar"), ("crítica", None, 600, None, "25", "opinion_review"),
             ("x", None, 600, None, "27", "divulgacion"), ("x", None, 600, None, None, "sin_clasificar")]
    rows = [item(i, title=t, tags=g, seconds=s, chapters=c, category=k) for i, (t, g, s, c, k, _) in enumerate(cases)]
    got = described(spark, *rows)
    assert [got[i].et_formato for i in range(len(cases))] == [c[-1] for c in cases]


def test_portion_edges(spark):
    seconds = [60, 61, 600, 601, 1800, 1801, 3600, 3601, None]
    got = described(spark, *[item(i, seconds=s) for i, s in enumerate(seconds)])
    assert [got[i].et_porcion for i in range(9)] == ["short", "corto", "corto", "medio", "medio", "largo", "largo", "muy_largo", "desconocida"]


def test_traceability_navigation_quality(spark):
    got = described(
        spark, item(1, description="https://www.ine.es/x"), item(2, description="http://a.example.com"), item(3, description="https://youtu.be/x"),
        item(4, description="1:00 2:00"), item(5, words(1500), chapters=2, auto=True), item(6, words(1500)), item(7, "pocas"))
    assert [got[i].et_trazabilidad for i in (1, 2, 3, 4)] == [
        "con_fuentes_verificables", "con_enlaces_externos", "solo_enlaces_propios", "sin_enlaces"]
    assert got[4].et_navegabilidad == "timestamps_en_descripcion" and got[5].et_navegabilidad == "con_indice"
    assert [got[i].et_calidad_dato for i in (1, 5, 6, 7)] == [
        "sin_transcripcion", "transcripcion_automatica", "transcripcion_humana", "transcripcion_parcial"]


def test_pace_ignores_bins_past_the_end_and_counts_empty_ones(spark):
    items = spark.createDataFrame([(1, 90), (2, 90), (3, 0), (4, 61)], "content_id long, duration_seconds int")
    segs = spark.createDataFrame(
        [(1, 0.0, "uno dos tres"), (1, 45.0, "x"), (1, 200.0, "fuera de todo"), (2, 10.0, ""), (3, 1.0, "a"), (4, 0.0, "él ñu")],
        "content_id long, start_s double, text string")
    got = {r.content_id: (r.ritmo_cv, r.p_tramo_silencioso) for r in I.pace(items, segs).collect()}
    series = [3, 1, 0]
    mean = sum(series) / 3
    sd = (sum((x - mean) ** 2 for x in series) / 3) ** 0.5
    assert got[1] == (round(sd / mean, 3), 0.333) and set(got) == {1, 4}
    spine = I.pace_spine(items, segs).groupBy("content_id").agg(F.count("*").alias("n"), F.sum("words").alias("w")).collect()
    assert {(r.content_id, r.n, r.w) for r in spine} == {(1, 3, 4), (2, 3, 0), (4, 3, 2)}


def test_an_own_indicator_joins_the_table(spark):
    I.register_indicator("letras", lambda p: F.length(p.folded))
    try:
        assert described(spark, item(1, "Él"))[1].letras == 2
    finally:
        I._EXTRA.pop("letras")


def test_gate_filter_does_not_tokenise_twice(spark):
    df = I.describe(spark.createDataFrame([item(1, "a b")], SCHEMA)).where("v_apto_panel = 1").select("content_id", "mattr_200")
    assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1


def test_panel_has_its_eight_descriptors():
    assert len(L.PANEL) == 8
