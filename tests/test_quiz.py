import random

import pytest
from pyspark.sql import functions as F

from contentgauge.operators import queue as QU, quiz as QZ

TEXT = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince"


def plain_longest(words, text):
    best = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            if " ".join(words[i:j]) in text:
                best = max(best, j - i)
    return best


def anchored(spark, *quotes):
    df = spark.createDataFrame([(i, q, TEXT) for i, q in enumerate(quotes)], "i int, cita string, transcript string")
    return [(r.anclada, r.motivo_anclaje) for r in QZ.anchoring(df).orderBy("i").collect()]


def test_anchoring_rules(spark):
    pad = lambda n: " ".join(f"zz{i}" for i in range(n))
    got = anchored(
        spark, "", None, "uno dos tres cuatro cinco", "¡Uno, dos, tres, cuatro, cinco, SEIS!", f"uno dos tres cuatro cinco {pad(5)}",
        f"uno dos tres cuatro cinco seis {pad(14)}", f"uno dos tres cuatro cinco {pad(3)}", pad(8))
    assert got == [
        (False, "cita_vacia"), (False, "cita_vacia"), (False, "cita_demasiado_corta_5_palabras"), (True, "literal"),
        (False, "no_encontrada_max_5_palabras"), (True, "parcial_6_de_20"), (True, "parcial_5_de_8"), (False, "no_encontrada_max_0_palabras")]


def test_longest_run_matches_a_full_search(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(60):
        text = " ".join(rng.choice("a b c aa ab".split()) for _ in range(30))
        cases.append(([rng.choice("a b c aa ab d".split()) for _ in range(rng.randrange(1, 12))], text))
    df = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(cases)], "i int, w array<string>, t string")
    got = {r.i: r.r for r in df.select("i", QZ.longest_run(F.col("w"), F.col("t")).alias("r")).collect()}
    assert got == {i: plain_longest(w, t) for i, (w, t) in enumerate(cases)}


def test_sufficiency(values):
    rows = [("Roma antigua", "en roma vivia", "dato"), ("Roma antigua imperial", "en roma", "dato"), ("Roma antigua imperial", "en roma", "relacion"),
            ("la de", "x", "dato"), ("Londres", "paris", "definicion")]
    r = QZ.sufficiency(F.col("a"), QZ.words_of(F.col("q")), F.col("k"))
    got = values(rows, "a string, q string, k string", r["ok"], r["motivo"])
    assert got == [(True, "dato_1_de_2"), (False, "dato_solo_1_de_3_pedia_2"), (True, "inferencia_1_de_3"), (False, "respuesta_vacia"),
                   (False, "inferencia_solo_0_de_1_pedia_1")]


@pytest.mark.parametrize("options, correct, motive", [
    (["1000 canales", "28 personas", "100 canales", "500 personas"], 1, "unidades_mezcladas_['canales', 'personas']"),
    (["1 euro", "50 euro", "10 euro", "20 euro"], 0, "equilibradas"),
    (["1 euro", "51 euro", "10 euro", "20 euro"], 0, "magnitudes_dispares_x51"),
    (["1 euro", "50,9 euro", "10 euro", "20 euro"], 0, "equilibradas"),
    (["a" * 16, "b" * 10, "c" * 10, "d" * 10], 0, "equilibradas"),
    (["a" * 17, "b" * 10, "c" * 10, "d" * 10], 0, "correcta_mas_larga_x1.70"),
    (["a" * 5, "b" * 10, "c" * 10, "d" * 10], 0, "equilibradas"),
    (["a" * 4, "b" * 10, "c" * 10, "d" * 10], 0, "correcta_mas_corta_x0.40"),
    (["los nazis", "Estados Unidos", "la Union", "Japon entero"], 0, "equilibradas"),
    (["solo"], 0, "faltan_opciones"),
])
def test_balance(values, options, correct, motive):
    assert values([(options, correct)], "o array<string>, c int", QZ.balance(F.col("o"), F.col("c"))["motivo"]) == [(motive,)]


def test_magnitude(values):
    rows = [("8,3 millones",), ("2 mil euros",), ("3 milimetros",), ("sin numero",), ("1.5",)]
    got = [r[0] for r in values(rows, "o string", QZ.magnitude(F.col("o")))]
    assert got == [8e6, 2000.0, 3.0, None, 1.0]     # the fold has taken the comma and the point


def test_shuffle_keeps_the_right_option(values):
    o = ["a", "b", "c", "d"]
    rows = [(k, o, i) for k in range(20) for i in range(4)]
    s = QZ.shuffled_options(F.col("o"), F.col("i"), F.col("k"), "1")
    got = values(rows, "k int, o array<string>, i int", "i", F.get(s["opciones"], s["correcta"]), F.array_sort(s["opciones"]), s["correcta"])
    assert all(o[i] == answer and full == o for i, answer, full, _ in got) and len({g[3] for g in got}) == 4


def test_cascade_names_the_first_failure(spark):
    quote = "uno dos tres cuatro cinco seis"
    ok = ["seis", "cien", "dosc", "tric"]
    rows = [(1, "¿?", ok, 0, quote, "dato", TEXT, 9), (2, " ", ok, 0, quote, "dato", TEXT, 0), (3, "¿?", ["Sí", "si", "b", "c"], 0, quote, "dato", TEXT, 0),
            (4, "¿?", ok, 7, quote, "dato", TEXT, 0), (5, "¿?", ok, 0, "otra cosa bien distinta de verdad aqui", "dato", TEXT, 0),
            (6, "¿?", ["roma", "cien", "dosc", "tric"], 0, quote, "dato", TEXT, 0), (7, "¿?", ["seis", "y" * 30, "z" * 30, "w" * 30], 0, quote, "dato", TEXT, 0),
            (8, "¿?", ok, 0, "usa mi codigo uno dos tres cuatro cinco seis", "dato", "usa mi codigo " + TEXT, 0), (9, "¿?", ok, 0, quote, "dato", TEXT, None)]
    df = spark.createDataFrame(rows, "pregunta_id int, pregunta string, opciones array<string>, correcta int, cita string, tipo string, transcript string, control_eleccion int")
    got = {r.pregunta_id: r for r in QZ.control(df).collect()}
    assert [got[i].descarte for i in range(1, 10)] == [
        None, "formato_invalido", "opciones_duplicadas", "indice_correcto_invalido", "cita_no_verificable", "cita_no_justifica",
        "opciones_desbalanceadas", "pregunta_sobre_publicidad", "control_fallo"]
    assert got[1].sobrevive and got[1].dificil and got[1].opciones[got[1].correcta] == "seis"
    assert got[5].justificada is None and got[7].equilibrada is False


def test_text_windows_match_a_plain_cut(spark):
    def plain(words, size, fractions):
        n, w = len(words), max(30, size // len(fractions))
        if n <= size:
            return " ".join(words)
        starts = [min(max(0, int(f * (n - w))), n - w) for f in fractions]
        return "\n[...]\n".join(" ".join(words[s:s + w]) for s in starts)

    for n in (5, 90, 91, 400):
        words = [f"w{i}" for i in range(n)]
        df = spark.createDataFrame([(" ".join(words), words)], "t string, w array<string>")
        got = df.select(QZ.sampled_text(F.col("t"), F.col("w"), 90, QZ.SECOND_WINDOWS), QZ.thirds(F.col("t"), F.col("w"), 90)).first()
        assert got[0] == plain(words, 90, QZ.SECOND_WINDOWS)
        if n > 90:
            parts = [words[0:30], words[n // 2 - 15:n // 2 + 15], words[n - 30:n]]
            assert got[1] == "\n[...]\n".join(" ".join(p) for p in parts)


def test_even_picks(spark):
    df = spark.range(103).select("id", (F.col("id") % 7).alias("v"))
    order = sorted(range(103), key=lambda i: (-(i % 7), i))
    got = {r.id for r in QZ.even_picks(df, "v", "id", 10).collect()}
    assert got == {order[int(i * 103 / 10)] for i in range(10)}
    assert QZ.even_picks(df, "v", "id", 200).count() == 103


def test_backoff(spark, values):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = [(s, a) for s in ("ok", "partial", "failed", "no_subs") for a in range(6)]
    r = QU.schedule(F.col("s"), F.col("a"), now)
    minutes = ((F.unix_micros(r["next_attempt_at"]) - F.unix_micros(now)) / 60_000_000).cast("int")
    got = {(s, a): rest for s, a, *rest in values(rows, "s string, a int", "s", "a", r["status"], r["attempts"], minutes)}
    assert [got[("partial", a)] for a in range(6)] == [
        ["partial", 1, 15], ["partial", 2, 60], ["partial", 3, 240], ["partial", 4, 1440], ["exhausted", 5, None], ["exhausted", 6, None]]
    assert got[("ok", 3)] == ["ok", 3, None] and got[("no_subs", 5)] == ["no_subs", 6, None]


def test_retry_needs_ninety_seconds(values):
    now = F.lit("2026-01-01 00:01:30").cast("timestamp")
    rows = [(None, None, "2026-01-01 00:00:00"), (None, None, "2026-01-01 00:00:01"), ("x", None, None), (" ", "error", None), (None, "exhausted", None)]
    got = values(rows, "t string, s string, l string", QU.should_retry(F.col("t"), F.col("s"), F.to_timestamp("l"), now))
    assert [g[0] for g in got] == [True, False, False, True, False]


def test_a_full_base_rate_has_no_corrected_retention(spark):
    q = spark.createDataFrame([(1, 5, True, False, True), (2, 6, True, True, False), (3, 6, False, True, False)],
                              "pregunta_id long, content_id long, utilizable boolean, dificil boolean, linea_base_acerto boolean")
    a = spark.createDataFrame([("p", 1, True, 1.0), ("p", 2, True, 2.0), ("p", 2, False, 4.0), ("p", 3, True, 9.0)],
                              "persona_id string, pregunta_id long, acierto boolean, dias double").withColumn("respondido_at", F.current_timestamp())
    got = {r.content_item_id: r for r in QZ.retention(a, q).collect()}
    assert got[5].retencion_corregida is None and got[5].retencion_dificil is None and got[5].tasa_linea_base == 1.0
    assert (got[6].n_items, got[6].retencion_bruta, got[6].retencion_corregida, got[6].dias_transcurridos) == (2, 0.5, 0.5, 3.0)


def test_unanswered_for_nobody_is_everything(spark):
    q = spark.createDataFrame([(1, 5), (2, 6), (3, 6)], "pregunta_id long, content_id long")
    a = spark.createDataFrame([("p", 2)], "persona_id string, pregunta_id long")
    assert QZ.unanswered(q, a, "").count() == 3
    assert [r.pregunta_id for r in QZ.unanswered(q, a, "p").collect()] == [1]


def test_form_fault_names_the_first(spark):
    good = ["uno", "dos", "tres", "cuatro"]
    rows = [("q", good, 0, None), ("q", good, 3, None), ("q", good, -4, None), ("q", good, 4, "indice_correcto_invalido"),
            ("q", good, None, "indice_correcto_invalido"), ("q", ["a", "b"], 0, "formato_invalido"), ("  ", good, 0, "formato_invalido"),
            (None, good, 0, "formato_invalido"), ("q", None, 0, "formato_invalido"), ("q", ["Sí", "si!", "no", "c"], 9, "opciones_duplicadas")]
    df = spark.createDataFrame(rows, "q string, o array<string>, c int, want string").coalesce(1)
    for r in df.withColumn("got", QZ.form_fault(F.col("q"), F.col("o"), F.col("c"))).collect():
        assert r.got == r.want, r


def test_adverts_by_their_phrases(values):
    rows = [("¡Usá mi CÓDIGO! usa mi código", True), ("la publicidad institucional", False), ("", False), (None, False)]
    assert [got for got, in values([(q,) for q, _ in rows], "q string", QZ.is_advert(F.col("q")))] == [w for _, w in rows]
    assert values([("Und die Zeit",)], "q string", QZ.is_advert(F.col("q"), ["und die"])) == [(True,)]


def test_a_quote_is_folded_once_for_all_phrases(spark):
    rows = spark.createDataFrame([(["Y mi  Curso!", None, "mi\tcursillo"],)], "q array<string>")
    found = rows.select(F.transform("q", lambda q: QZ.is_advert(q)).alias("r"))
    assert found.first().r == [True, False, False]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_unbacked_formats(values):
    rows = [("informativo", None, True), ("informativo", "directo", True), ("informativo", "actualidad", False),
            ("entretenimiento", "directo", False), ("entretenimiento", None, False)]
    assert [got for got, in values([r[:2] for r in rows], "f string, e string", QZ.unbacked(F.col("f"), F.col("e")))] == [r[2] for r in rows]


def test_outcome_of_a_fetch(values):
    """What came back first, then the real hints in their order, in either case."""
    rows = [(True, True, "Video unavailable", "ok"), (True, False, "Video unavailable: private video", "unavailable"),
            (False, False, "The uploader has not made this video available in your country. Video unavailable", "geo_blocked"),
            (True, False, "TranscriptsDisabled", "no_subs"), (False, False, "sin subtítulos disponibles; video unavailable", "unavailable"),
            (True, False, "HTTP Error 500", "partial"), (False, True, "TranscriptsDisabled", "partial"), (False, False, "HTTP Error 500", "failed"),
            (True, False, None, "partial"), (False, False, None, "failed")]
    got = values([r[:3] for r in rows], "m boolean, t boolean, e string", QU.outcome(F.col("m"), F.col("t"), F.col("e")))
    assert [g for g, in got] == [r[3] for r in rows]
    own = QU.outcome(F.col("m"), F.col("t"), F.col("e"), geo=["http"], gone=[], no_subs=[])
    assert values([(False, False, "HTTP Error 500")], "m boolean, t boolean, e string", own) == [("geo_blocked",)]
