"""The Merkle manifest next to a plain one."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contentgauge.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    out = ""
    for v in (doc_id, source, lang, n_chars, text):
        s = None if v is None else str(v)
        out += "-" if s is None else f"{len(s.encode())}:{s}"
    return sha(out)


def climb(digests):
    """(root, [[(left, right) per level] per node])"""
    paths, where, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for node, at in enumerate(where):
            start = at - at % 3
            paths[node].append(("".join(level[start:at]), "".join(level[at + 1:start + 3])))
            where[node] = at // 3
        level = [sha(*level[k:k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n_chars = r[:5]
        bad = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        claimed = leaf(doc_id, text.replace("\n", ""), lang, source, n_chars) if bad else leaf(*r[:5])
        groups[(source is not None, (source or "").encode())].append(
            ((doc_id is not None, doc_id or 0), leaf(*r[:5]), doc_id, claimed))
    keys = sorted(groups)
    trees = [climb([x[1] for x in sorted(groups[k], key=lambda x: x[:2])]) for k in keys]
    if not keys:
        return []
    root, up = climb([t[0] for t in trees])
    out = []
    for k, (subroot, paths), more in zip(keys, trees, up, strict=True):
        for (_, digest, doc_id, claimed), path in zip(sorted(groups[k], key=lambda x: x[:2]), paths, strict=True):
            at = claimed
            for left, right in path + more:
                at = sha(left, at, right)
            out.append((doc_id, digest, subroot, root, sha(*[a + b for a, b in path + more]), at, at == root))
    return sorted(out, key=repr)


def found(df):
    made = manifest.manifest(df, claimed=manifest.without_breaks(df))
    return sorted([tuple(r) for r in made.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("p"),
        manifest.fold(F.col("claimed"), F.col("path")).alias("f"),
        (manifest.fold(F.col("claimed"), F.col("path")) == F.col("root")).alias("v")).collect()], key=repr)


def row(k, source, text="a\nb"):
    return (k, text, "en", source, 3, "clash", 1)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 9, 10), (243, 244, 1), (800, 7)])
def test_equals_plain_version(frame, sizes):
    rows = [row(k * 3, f"s{g}", f"text {k}\nof {g}") for g, n in enumerate(sizes) for k in range(n)]
    assert found(frame(rows, SCHEMA)) == expected(rows)


def test_third_round(frame, monkeypatch):
    """Blocks of three nodes: many rounds for a few hundred leaves and many groups."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "SPAN", 3)
    rows = [row(k, f"s{k % 5}" if k % 3 else "hot") for k in range(70)]
    assert found(frame(rows, SCHEMA)) == expected(rows)


def test_nulls_ties_and_repeated_rows(frame):
    rows = [row(1, None), row(None, None, None), row(None, "", ""), row(1, None), row(1, None), row(2, "=", "é\n" * 50_000),
            (7, "x\ny", None, "é", None, None, None), (7, "x\nz", None, "é", None, None, None), (-5, "\n", "", "z", 0, "", 0)]
    assert found(frame(rows, SCHEMA)) == expected(rows)


def test_empty_table(frame):
    assert found(frame([], SCHEMA)) == []


def test_claims_of_changed_rows_fail(frame):
    rows = [row(k, "a", "one line" if k % 3 else "two\nlines") for k in range(40)]
    for doc_id, *_, verified in found(frame(rows, SCHEMA)):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 2 == 1 or doc_id % 3 != 0)
