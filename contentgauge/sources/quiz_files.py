"""Quiz and answer files, and what can be saved from a cut JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentgauge.sources.snapshots import write_csv

QUESTION = """STRUCT<pregunta: STRING, opciones: ARRAY<STRING>, cita: STRING, tipo: STRING, anclada: BOOLEAN,
 motivo_anclaje: STRING, justificada: BOOLEAN, motivo_justificacion: STRING, equilibrada: BOOLEAN,
 motivo_equilibrio: STRING, linea_base_acerto: BOOLEAN, dificil: BOOLEAN, trivial: BOOLEAN, control_eleccion: INT,
 control_seguridad: STRING, sobrevive: BOOLEAN, descarte: STRING, correcta: INT>"""
QUIZ = f"""content_item_id BIGINT, external_id STRING, titulo STRING, canal STRING, formato STRING, n_palabras INT,
 modelo STRING, modelo_control STRING, version STRING, generado_at STRING, error STRING, preguntas ARRAY<{QUESTION}>"""
ANSWERS = """persona_id STRING, completado_at STRING, videos_excluidos ARRAY<BIGINT>,
 respuestas ARRAY<STRUCT<pregunta_id: BIGINT, eleccion: INT, acierto: BOOLEAN, segundos: INT,
   dias_transcurridos: DOUBLE, intento: INT>>"""
GENERATED = "STRUCT<pregunta: STRING, opciones: ARRAY<STRING>, correcta: INT, cita: STRING, tipo: STRING>"


def read_quiz(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUIZ).option("multiLine", True).json(path)


def quiz_questions(videos: DataFrame) -> DataFrame:
    """One row per question with its place; videos with an error and questions without
    a right answer are left out."""
    rows = videos.where(F.coalesce("error", F.lit("")) == "").select(
        "content_item_id", "version", "modelo", "modelo_control", "generado_at", F.posexplode("preguntas").alias("n_orden", "q"))
    return rows.where("q.correcta is not null").select(
        "content_item_id", "version", "modelo", "modelo_control", "n_orden", "generado_at", "q.*").withColumnsRenamed(
        {"sobrevive": "utilizable", "control_eleccion": "linea_base_eleccion", "control_seguridad": "linea_base_seguridad"}
    ).withColumn("utilizable", F.coalesce("utilizable", F.lit(False))).drop("trivial")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return answer_rows(spark.read.schema(ANSWERS).option("multiLine", True).json(path))


def answer_rows(files: DataFrame) -> DataFrame:
    """One row per answer; the attempt is 1 unless given."""
    rows = files.select("persona_id", F.explode("respuestas").alias("r"))
    return rows.select("persona_id", "r.pregunta_id", "r.eleccion", "r.acierto",
                       F.col("r.segundos").alias("segundos_respuesta"), "r.dias_transcurridos",
                       F.coalesce("r.intento", F.lit(1)).alias("intento"))


def flat_questions(videos: DataFrame) -> DataFrame:
    """The flat export: four option columns, '' where there is none."""
    rows = videos.select("content_item_id", "external_id", "titulo", "formato", "n_palabras", F.explode("preguntas").alias("q"))
    options = [F.coalesce(F.get("q.opciones", F.lit(i)), F.lit("")).alias(f"op{i}") for i in range(4)]
    return rows.select(
        "content_item_id", "external_id", "titulo", "formato", "n_palabras", "q.tipo", "q.pregunta", *options,
        "q.correcta", "q.anclada", "q.motivo_anclaje", "q.linea_base_acerto", "q.dificil", "q.control_seguridad",
        F.col("q.sobrevive").alias("utilizable"), F.coalesce("q.descarte", F.lit("")).alias("descarte"))


def write_flat(videos: DataFrame, path: str) -> None:
    write_csv(flat_questions(videos), path, sep=";")


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# a whole object without an object in it; strings are read over, so their braces do not count
OBJECT_OR_STRING = r'(?s)\{[^{}"]*+(?:' + _STRING + r'[^{}"]*+)*+\}|' + _STRING


def saved_questions(text: Column) -> Column:
    """The complete question objects of a text that breaks off, in order, as JSON texts.

    A question holds no objects, so the pattern reads the text once: strings outside of questions are taken whole,
    what else is not part of a complete object is passed by.
    """
    objects = F.filter(F.regexp_extract_all(text, F.lit(OBJECT_OR_STRING), F.lit(0)), lambda x: F.startswith(x, F.lit("{")))
    keys = lambda x: F.json_object_keys(x)
    return F.filter(objects, lambda x: F.try_parse_json(x).isNotNull() & F.coalesce(
        F.array_contains(keys(x), "pregunta") & F.array_contains(keys(x), "opciones"), F.lit(False)))


def parse_questions(raw: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, n_orden, question columns) from generated JSON texts.

    A text that does not parse gives every complete question before the cut.
    """
    text = F.trim(column)
    whole = F.try_parse_json(text).isNotNull()
    good = raw.where(whole).select(
        *keys, F.from_json(text, f"STRUCT<preguntas: ARRAY<{GENERATED}>>")["preguntas"].alias("q"))
    cut = raw.where(~whole).select(*keys, F.transform(
        saved_questions(F.col(column)), lambda x: F.from_json(x, GENERATED)).alias("q"))
    return good.unionByName(cut).select(*keys, F.posexplode("q").alias("n_orden", "q")).select(*keys, "n_orden", "q.*")
