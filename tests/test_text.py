import random
import re
import unicodedata

from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L, links, numbers, strata, text as T
from contentgauge.operators.indicators import NUMBER, YEAR


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")


def counted(s, phrases):
    return sum(len(re.findall(r"(?<![a-z0-9])" + re.escape(p) + r"(?![a-z0-9])", s)) for p in phrases)


def test_fold_drops_accents_of_any_script(values):
    texts = ["ÁÉÍÓÚ Ñandú çà", "İstanbul", "él", "Ελλάδα Ђорђе й", "straße Øl", "", "ǖ ệ"]
    got = values([(t,) for t in texts], "t string", T.fold(F.col("t")))
    assert [g[0] for g in got] == [plain(t) for t in texts]
    assert values([(None,)], "t string", T.fold(F.col("t"))) == [("",)]


def test_quiz_fold(values):
    got = values([("¡Sí, Año 2.000—½  ﬁn!",), (None,)], "t string", T.quiz_fold(F.col("t")))
    assert got[0][0].startswith("si ano 2 000") and got[1] == ("",)


def test_phrases_count_like_one_search_per_phrase(spark):
    rng = random.Random(3)
    lists = {k: v["es"] + v["en"] for k, v in L.LEXICONS.items()} | {"units": L.UNITS, "numbers": L.NUMBER_WORDS,
             "edges": ["mano a mano", "a", "a a", "miles", "miles de millones", "millones de"]}
    vocabulary = [w for p in lists.values() for q in p for w in (q, q.split()[0])] + ["porqueX", "x1", "a", "mano", "12a", "\n"]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(80)]
    texts += ["porque porque", "porquex porque", "mano a mano a mano", "a a a a", "miles de millones", "el mejor", "suscribete", ""]
    scan = T.PhraseScan(p for q in lists.values() for p in q)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", scan.hits(F.col("t")))
    rows = df.select("t", *[scan.count("h", "t", p).alias(k) for k, p in lists.items()]).collect()
    for row in rows:
        for key, phrases in lists.items():
            assert row[key] == counted(row["t"], phrases), (key, row["t"])
    short = df.select("t", *[T.count_phrases(F.col("t"), p).alias(k) for k, p in lists.items()]).collect()
    assert [[r[k] for k in lists] for r in short] == [[r[k] for k in lists] for r in rows]


def test_stems_never_match_inflected_words(values):
    assert values([("suscribete suscrib",)], "t string", T.count_phrases(F.col("t"), ["suscrib"])) == [(1,)]


def test_numbers_and_years(values):
    texts = ["12a 3d 1.000,5 50 %", "a12 12", "1599 1600 2049 2050", "x1,2y 3.", "7", "é1999 _1999 1999."]
    got = values([(t,) for t in texts], "t string", F.regexp_count("t", F.lit(NUMBER)), F.regexp_count("t", F.lit(YEAR)))
    want = [(len(re.findall(r"(?<![a-z])\d[\d.,]*(?![a-z])", t)), len(re.findall(r"\b(1[6-9]\d{2}|20[0-4]\d)\b", t))) for t in texts]
    assert got == want


def test_iso_durations(values):
    rows = [("PT1H2M3S",), ("P1DT0S",), ("PT0S",), ("",), (None,), ("PT5M",), ("1H",)]
    got = values(rows, "d string", numbers.iso_seconds(F.col("d")), numbers.iso_seconds(F.col("d"), True))
    assert got == [(3723, 3723), (None, 86400), (None, 0), (None, None), (None, None), (300, 300), (None, None)]


def test_rounding_goes_to_even(values):
    got = values([(54.25,), (0.625,), (0.375,), (None,)], "x double", numbers.half_even(F.col("x"), 1), numbers.half_even(F.col("x"), 2))
    assert got == [(54.2, 54.25), (0.6, 0.62), (0.4, 0.38), (None, None)]


def test_width_cap_and_clean_number(values):
    assert values([("  es-419-x ",), ("   ",), (None,)], "t string", numbers.cap_width(F.col("t"), 6)) == [("es-419",), (None,), (None,)]
    assert values([(float("nan"),), (float("-inf"),), (2.0,)], "x double", numbers.clean_number(F.col("x"))) == [(None,), (None,), (2.0,)]


def test_links_are_classed_by_host(values):
    text = "see https://youtu.be/x (https://www.ine.es/a) http://blog.example.com/b, 1:02 and 10:20:30 or 123:45"
    urls = links.links(F.col("t"))
    got = values([(text,), (None,)], "t string", F.size(urls), F.size(links.external(urls)), F.size(links.traceable(urls)),
                 links.time_marks(F.col("t")))
    assert got == [(3, 2, 1, 2), (0, 0, 0, 0)]


def test_duration_strata_edges(values):
    seconds = [119, 120, 599, 600, 1799, 1800, 10800, 10801, None]
    got = [r[0] for r in values([(s,) for s in seconds], "s int", strata.duration_bucket(F.col("s")))]
    assert got == [None, "corto", "corto", "medio", "medio", "largo", "largo", None, None]


def test_language_choice_depends_on_which_column_is_first(values):
    rows = [("es", "en-US"), (None, "en"), ("", None), ("EN", "es"), ("fr", None)]
    got = values(rows, "v string, t string", T.lexicon_language(F.col("v"), F.col("t"), "video"),
                 T.lexicon_language(F.col("v"), F.col("t"), "transcript"))
    assert got == [("es", "en"), ("en", "en"), ("es", "es"), ("es", "es"), ("es", "es")]


def test_spanish_detector(values):
    rows = [("la casa de la vida es muy grande",), ("la de que el",), ("this is a long text without such words at all today",), (None,)]
    assert [r[0] for r in values(rows, "t string", T.looks_spanish(F.col("t")))] == [True, False, False, False]
