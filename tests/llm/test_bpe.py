import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contentgauge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdeABC sS'tT  \n\t\x1c\x85\xa0éÉüßΣςσİÅ한語😂🇺🇸1½²Ⅷ٣!?.-_<|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n):
    draw = random.Random(3)
    out = ["", " ", "a" * 3000, "😂" * 200, "ha" * 2000 + " x", "=" * 5000,
           "".join(draw.choice("etaoinshr") for _ in range(5000)), "x<|endoftext|>Y <|startoftext|>"]
    for _ in range(n):
        out.append("".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))))
    return out


def test_lookahead_of_a_chain():
    # c d | bc | ab: what follows "abc" decides about its first letter
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c"), ("c", "d")]) == 1
    assert bpe.sufficient_lookahead([("a", "b")], end="</w>") == 2


def test_lookahead_bounds_what_changes():
    draw = random.Random(1)
    words = bpe.vocabulary(PATH)
    for _ in range(200):
        known = "".join(draw.choice("aeinrsth") for _ in range(words.lookahead + 60))
        a, b = (known + "".join(draw.choice("aeinrsthxyz") for _ in range(20)) for _ in range(2))
        ends = []
        for text in (a, b):
            at, out = 0, set()
            for t in words.merged([words.ids[c] for c in text]):
                at += len(words.tokens[t])
                out.add(at)
            ends.append({e for e in out if e <= len(known) - words.lookahead})
        assert ends[0] == ends[1]


def test_ids_equal_the_library(library):
    many = texts(1500)
    ids, ends = bpe.encoder(PATH).batch(many)
    for k, text in enumerate(many):
        assert ids[ends[k]:ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_parts_of_any_size_give_the_same_ids():
    words = bpe.vocabulary(PATH)
    piece = ("lorem" * 900).encode()
    whole = bpe.Transducer(words)
    want = [*whole.feed(piece), *whole.finish()]
    for size in (1, 7, 1000):
        t, got = bpe.Transducer(words), []
        for at in range(0, len(piece), size):
            got += t.feed(piece[at:at + size])
            assert len(t.held) < 2 * t.window
        assert got + t.finish() == want


def test_decoding_in_parts_equals_the_library(library):
    words, draw = bpe.vocabulary(PATH), random.Random(2)
    for _ in range(200):
        ids = [draw.randrange(49_408) for _ in range(draw.randint(0, 30))]
        state, cut = bpe.Decoder(words), draw.randint(0, 30)
        assert state.feed(ids[:cut]) + state.feed(ids[cut:]) + state.finish() == library.decode(ids, skip_special_tokens=False)


def test_byte_state_machine_waits_for_the_rest_of_a_character():
    words = bpe.Vocabulary(PATH)
    words.decoder = "ByteLevel"
    state = bpe.Decoder(words)
    euro = [words.ids[words.symbols[b]] for b in "€".encode()]
    assert [state.feed([i]) for i in euro] == ["", "", "€"]
    assert state.feed(euro[:1]) + state.finish() == "�"


def test_table_with_nulls_and_other_columns(frame, library):
    df = frame([(1, "Hi THERE", "a"), (2, None, "b"), (2, "", "c"), (None, "x" * 4000, None)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, name="tokens"), PATH, "tokens").collect()
    assert len(rows) == 4
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens == want and r.decoded == library.decode(want, skip_special_tokens=False)
    empty = frame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_a_batch_does_not_run_through_what_is_known():
    """Words and pieces that are known are looked up, whatever their number; odd white space and special tokens in between."""
    class Known(dict):
        def keys(self):
            raise AssertionError("all known words")

        __iter__ = keys

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coder = bpe.Encoder(bpe.vocabulary(path))
    coder.known, coder.piece = Known(), Known()
    texts = ["a\x1cb <|endoftext|>x ΑΣ é É\u0301 q\u3000w\x85z", None, "", "<|startoftext|>", "don't  it's'll 12ab--??<|endoftext|><|endoftext|>",
             "\u0301 \u0301a\x1f\x1e", "\u212b \uf900 x\u0323\u0307", "İI ẞ ǅ"]
    for _ in range(2):
        values, ends = coder.batch(texts)
        assert [values[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [
            library.encode(t or "", add_special_tokens=False).ids for t in texts]
