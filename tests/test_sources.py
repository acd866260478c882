import json

import pytest
from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L
from contentgauge.operators import merge as M
from contentgauge.sources import captions as C, media_api as A, quiz_files as Z, snapshots as S


def test_json3_captions(spark, tmp_path):
    events = [{"tStartMs": 1234, "dDurationMs": 2005, "segs": [{"utf8": "hola "}, {"utf8": "mundo"}]},
              {"tStartMs": 5000, "segs": [{"utf8": "\n"}, {"utf8": " "}]}, {"tStartMs": 6000, "dDurationMs": 1000},
              {"dDurationMs": 1, "segs": [{"utf8": "sin inicio"}, {}]}]
    (tmp_path / "a.json").write_text(json.dumps({"events": events}, indent=1))
    got = [(r.text, r.start, r.duration) for r in C.read_json3(spark, str(tmp_path)).orderBy("pos").collect() if r.text.strip()]
    assert got == [("hola mundo", 1.23, 2.0), ("sin inicio", 0.0, 0.0)]


CUES = """WEBVTT
Kind: captions
Language: es

00:00:01.000 --> 00:00:03.500 align:start
<c>hola</c> mundo
hola mundo
otra

01:02.250 --> 01:04,250
NOTE nada
hola mundo

00:01:10.000 --> 00:01:11.000
"""


def test_cue_captions(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(CUES)
    (tmp_path / "b.vtt").write_text(CUES.replace("\n", "\r\n"))
    rows = C.read_cues(spark, str(tmp_path)).orderBy("file", "cue").collect()
    want = [("hola mundo otra", 1.0, 2.5), ("hola mundo", 62.25, 2.0)]
    assert [(r.text, r.start, r.duration) for r in rows] == want * 2


def test_transcript_assembly(spark):
    df = spark.createDataFrame([(1, 5.0, "mundo [Música]"), (1, 0.0, "hola ♪ la la ♪"), (2, 0.0, "(risas)  "), (1, 9.0, "fin [" + "x" * 41 + "]")],
                               "i int, start_s double, text string")
    got = {r.i: (r.transcript, r.transcript_source) for r in C.assemble(df, "i", generated=F.lit(True)).collect()}
    assert got == {1: ("hola mundo fin [" + "x" * 41 + "]", "youtube_auto"), 2: (None, None)}


def test_video_api_items(spark, tmp_path):
    base = {"snippet": {"title": "T", "description": "la casa de la vida es muy grande", "channelId": "c" * 60, "categoryId": "25", "publishedAt": "2026-02-03T10:00:00Z"},
            "contentDetails": {"duration": "PT10M"}, "status": {"privacyStatus": "public"}, "statistics": {"viewCount": "12"}}

    def variant(i, **changes):
        out = json.loads(json.dumps(base)) | {"id": i}
        for path, value in changes.items():
            a, b = path.split("__")
            out[a][b] = value
        return out

    items = [variant("ok"), variant("private", status__privacyStatus="private"), variant("region", contentDetails__regionRestriction={"blocked": ["ES"]}),
             variant("bad", contentDetails__duration="x"), variant("short", contentDetails__duration="PT1M59S"), variant("long", contentDetails__duration="PT3H1S"),
             variant("cat", snippet__categoryId="29"), variant("en", snippet__defaultLanguage="EN-us"), variant("es", snippet__defaultAudioLanguage="es-AR", snippet__description=""),
             variant("unknown", snippet__description="x"), variant("edge", contentDetails__duration="PT3H")]
    (tmp_path / "i.json").write_text("\n".join(json.dumps(i) for i in items))
    raw = A.read_items(spark, str(tmp_path))
    got = {r.external_id: r for r in A.candidates(raw, "chart_canal", "s").collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "ok": "ACEPTADO", "private": "no_publico", "region": "restringido_por_region", "bad": "duracion_ilegible",
        "short": "corto_menos_2min (Shorts y clips)", "long": "largo_mas_3h (streams)", "cat": "categoria_no_mapeada (29)",
        "en": "idioma_declarado_no_es (en-us)", "es": "ACEPTADO", "unknown": "idioma_no_detectado_como_es", "edge": "ACEPTADO"}
    assert (got["ok"].stratum_format, got["ok"].stratum_duration, got["es"].video_language, got["ok"].video_language) == ("informativo", "medio", "es-ar", "es?")
    meta = {r.external_id: r for r in A.item_metadata(raw).collect()}
    r = meta["ok"]
    assert (r.category_name, r.view_count, r.like_count, str(r.upload_date), len(r.channel_id), r.duration_seconds) == (
        "News & Politics", 12, 0, "2026-02-03", 50, 600)
    assert meta["bad"].duration_seconds is None and meta["es"].video_language == "es-AR"


def test_extractor_metadata(spark, tmp_path):
    rows = [{"id": "a", "uploader": "u", "categories": ["Comedy", "x"], "chapters": [{"title": "t", "start_time": 0, "end_time": 5}], "upload_date": "20260203"},
            {"id": "b", "channel": "c", "upload_date": "2026"}]
    (tmp_path / "i.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.external_id: r for r in A.extracted_metadata(A.read_extracted(spark, str(tmp_path))).collect()}
    assert (got["a"].channel, got["a"].category_id, got["a"].n_chapters, str(got["a"].upload_date)) == ("u", "23", 1, "2026-02-03")
    assert (got["b"].channel, got["b"].category_id, got["b"].n_chapters, got["b"].upload_date) == ("c", None, 0, None)


def question(**more):
    return {"pregunta": "¿?", "opciones": ["a", "b"], "correcta": 1, "cita": "c", "tipo": "dato", "sobrevive": True, "anclada": True} | more


def test_quiz_and_answer_files(spark, tmp_path):
    videos = [{"content_item_id": 1, "external_id": "x", "version": "1", "preguntas": [question(), question(correcta=None), question(descarte="cita", sobrevive=False)]},
              {"content_item_id": 2, "version": "1", "error": "roto", "preguntas": [question()]}]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "quiz.json").write_text(json.dumps(videos, indent=1))
    raw = Z.read_quiz(spark, str(tmp_path / "q"))
    got = Z.quiz_questions(raw).orderBy("n_orden").collect()
    assert [(r.content_item_id, r.n_orden, r.utilizable) for r in got] == [(1, 0, True), (1, 2, False)]
    Z.write_flat(raw, str(tmp_path / "flat"))
    flat = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "flat"))
    assert flat.count() == 4 and flat.columns[7:11] == ["op0", "op1", "op2", "op3"]
    answers = {"persona_id": "p", "respuestas": [{"pregunta_id": 1, "eleccion": 0, "acierto": False, "segundos": 3}, {"pregunta_id": 2, "eleccion": 1, "acierto": True, "intento": 2}]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps(answers, indent=1))
    assert [(r.persona_id, r.pregunta_id, r.intento) for r in Z.read_answers(spark, str(tmp_path / "r")).orderBy("pregunta_id").collect()] == [("p", 1, 1), ("p", 2, 2)]


def test_questions_before_a_cut_are_saved(spark):
    whole = json.dumps({"preguntas": [question(pregunta=f'q{i} }}{{ "') for i in range(3)]})
    rows = [("whole", whole), ("cut", whole[:-12]), ("junk", "no es json"), ("empty", '{"preguntas": []}')]
    got = Z.parse_questions(spark.createDataFrame(rows, "k string, raw string"), "raw", ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"whole": 3, "cut": 2}


def panel(percentiles, keys=L.PANEL):
    return [(k, p) for k, p in zip(keys, percentiles)]


def test_dashboard_rows_and_snapshot(spark, tmp_path):
    rows = [(None, "c", "informativo", 90, 10, panel([50.0, None, 99.0, 0.0, 1.0, 2.0, 3.0, 4.0]))]
    df = spark.createDataFrame(rows, "title string, channel string, formato string, duration_seconds int, n_words int, panel array<struct<clave:string,percentil:double>>")
    df = df.withColumn("watched_at", F.lit("2026-01-01 23:30:00").cast("timestamp"))
    r = S.dashboard_rows(df).first()
    assert (r.titulo, r.fecha, r.minutos, r.p0, r.p1, r.p7) == ("(sin titulo)", "2026-01-02", 1.5, 50, None, 4)
    (tmp_path / "s.json").write_text(json.dumps([list(r), ["t", "c", None, "2026-01-01", 2.5, None, *range(8)]], ensure_ascii=False))
    back = S.read_dashboard(spark, str(tmp_path / "s.json")).orderBy("fecha").collect()
    assert tuple(back[1]) == tuple(r) and back[0].minutos == 2.5 and back[0].p7 == 7


def test_an_incomplete_panel_is_an_error(spark):
    df = spark.createDataFrame([("t", "c", "f", 60, 1, panel([1.0] * 7, L.PANEL[:7]))],
                               "title string, channel string, formato string, duration_seconds int, n_words int, panel array<struct<clave:string,percentil:double>>")
    with pytest.raises(Exception, match="panel without cobertura_titulo"):
        S.dashboard_rows(df.withColumn("watched_at", F.current_timestamp())).collect()


def test_csv_json_and_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 'a "b"\nc'), (2, 1.5, None)], "id int, x double, t string")
    S.write_json(df, str(tmp_path / "j"))
    assert sorted((r.id, r.x) for r in spark.read.schema("id int, x double").json(str(tmp_path / "j")).collect()) == [(1, None), (2, 1.5)]
    S.write_csv(df.select("id", "t"), str(tmp_path / "c"))
    assert {(r.id, r.t) for r in S.read_items_csv(spark, str(tmp_path / "c"), "id int, t string").collect()} == {(1, 'a "b"\nc'), (2, None)}
    for _ in range(2):
        S.append_report(df.select("id").coalesce(1), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 4


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1, None), (2, "b", 2, "x")], "k int, a string, b int, t string")
    new = spark.createDataFrame([(2, None, 9, "y", 1), (2, "c", None, "z", 2), (3, "d", 3, "w", 1)], "k int, a string, b int, t string, v int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(M.overwrite(old, new, ["k"], ["v"])) == [(1, "a", 1, None), (2, "c", None, "z"), (3, "d", 3, "w")]
    assert rows(M.overwrite_columns(old, new, ["k"], ["a"], ["v"], {"t": F.lit("now")})) == [(1, "a", 1, None), (2, "c", 2, "now"), (3, "d", 3, "w")]
    one = M.one_per_key(new, ["k"], ["v"])
    assert rows(M.coalesce_merge(old, one, "k", ["a", "b"], [], {"t": F.col("_new.b").isNotNull()}, F.lit("now"))) == [(1, "a", 1, None), (2, "c", 2, "x")]
    assert rows(M.insert_absent(old.select("k"), new.select("k", "v"), "k", ["v"])) == [(3, 1)]
    assert rows(M.first_source_wins([old.select("k", "a"), new.select("k", "a")], "k").where("k = 2")) == [(2, "b")]
