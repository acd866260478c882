import re
from collections import Counter

from contentgauge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The cat of the house and the dog in the garden went to see an old friend that lives by a river. "


def measured(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


CASES = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 50, "é😂 \xa0 z\x0bq", "a\na\n\n\nb\na", "a \na\na ",
    "# * $ % & | < >", PROSE, PROSE * 3, PROSE + " 1 2 3 4 5 6 7 8 9 10 " * 2, "w " * 20_000,
    " ".join(f"w{k}" for k in range(30_000)), "a b c d e f a b c d e g a b c d e", "A" * 200_000,
]


def test_measures_equal_brute_force(frame):
    rows = [(k, text, "n") for k, text in enumerate(CASES)] + [(0, PROSE, "again")]
    got = quality.assess(frame(rows, "doc_id int, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measured(r.text), r.text
        assert not (r.base_failed and r.kept)


def test_prose_stays_and_junk_goes(frame):
    good = [PROSE + "Many more words follow here.", "La maison de la rue et le jardin des voisins sont sur une colline avec un arbre."]
    bad = ["BUY!! NOW!! THE!! BEST!! OFFER!! OF!! THE!! WHOLE!! YEAR!! ONLY!! TODAY!! HERE!!", "a | b | c | d | e | f | g | h | i | j | k",
           "this this this this and and and and or or or or it it it it", "gskdj " + "qwe rtz uio pas dfg hjk lyx cvb nmq wer " * 4]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    kept = {r.doc_id for r in quality.keep_good(frame(rows, "doc_id int, text string")).collect()}
    assert kept == {0, 1}


def test_filter_keeps_columns_of_any_name(frame):
    df = frame([(1, PROSE, True, 3)], "doc_id int, text string, kept boolean, n_words int")
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.collect() == df.collect()
    assert quality.keep_good(df.where("doc_id = 0")).collect() == []
