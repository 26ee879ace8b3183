"""op6: removed lines against a direct comparison of all pairs of lines."""
import random

import pytest
from pyspark.sql import functions as F

from claimwise.llm import line_dedup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, words_per_edit=10):
    """Rows of the same doc_id and text share their place; earlier means a smaller place."""
    places = {}
    for i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().split())
            if w:
                place = (i is None, i or 0, j)
                places[w] = min(places.get(w, place), place)
    dropped = {w for w, p in places.items() if any(q < p and max(len(w), len(v)) >= words_per_edit and abs(len(w) - len(v)) <= 1
                                             and len(set(w) ^ set(v)) <= 2 and edits(w, v) <= 1 for v, q in places.items() if v != w)}
    out = []
    for i, t in rows:
        keep, n = [], 0
        for j, line in enumerate((t or "").split("\n")):
            w = tuple(line.encode().split())
            if not w or places[w] == (i is None, i or 0, j) and w not in dropped:
                keep.append(line)
            else:
                n += 1
        out.append((i, None if t is None else "\n".join(keep), n))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_removed").collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    lines = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 3, 8, 9, 10, 11, 14]))] for _ in range(25)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(lines))
            kind = rng.random()
            at = rng.randrange(len(w))
            if kind < 0.3:
                w[at] = f"z{rng.randrange(6)}"
            elif kind < 0.45:
                w.insert(at, f"y{rng.randrange(6)}")
            elif kind < 0.6 and len(w) > 1:
                del w[at]
            text.append(rng.choice(["", " "]) + " ".join(w))
            if rng.random() < 0.1:
                text.append("")
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(documents, seed):
    rows = corpus(seed)
    assert result(ld.dedup_lines(documents(rows))) == brute(rows)


def test_shuffle_joins_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    rows = corpus(4)
    assert result(ld.dedup_lines(documents(rows))) == brute(rows)


def test_nulls_blank_repeated_rows_and_extra_columns(documents):
    rows = [(3, "a b\na b\n\n c"), (3, "a b\na b\n\n c"), (None, "a b\nnew"), (1, None), (2, ""), (4, "\n \n"), (5, "w " * 1_500), (6, "w " * 1_501 + "\nc\tx")]
    docs = documents(rows, {"h1": F.lit("clash"), "line": F.lit(1), "doc": F.lit(2), "th": F.lit(3), "n": F.lit(4)})
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    assert result(out) == brute(rows)


def test_short_lines_are_no_partners_of_each_other(documents):
    """Two 9-word lines one word apart are not near; the earlier one must not hide the 10-word line that is."""
    rows = [(1, "a b c d e f g h X"), (2, "a b c d e f g h i y"), (3, "a b c d e f g h i"), (4, "p q r s t u v w 1"), (5, "p q r s t u v w 2")]
    got = result(ld.dedup_lines(documents(rows)))
    assert got == brute(rows)
    assert [n for *_, n in got] == [0, 0, 1, 0, 0]


def test_empty_table(documents):
    assert result(ld.dedup_lines(documents([]))) == []


def test_one_line_in_every_document(documents):
    rows = [(i, "the same line stands in every one of these documents here\nown " + str(i)) for i in range(200)]
    got = result(ld.dedup_lines(documents(rows)))
    assert sum(n for *_, n in got) == 199


def test_within_one_edit():
    for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("bc", "abc"), ("", "a"), ("ab", "ba"), ("abcd", "ab"), ("abc", "xbd")):
        assert ld.within_one_edit(list(a), list(b)) == (edits(a, b) <= 1)


def test_columns_named_like_the_generated_ones(documents):
    docs = documents([(1, "a line\nanother"), (2, "a line")], {"n_removed": F.lit("x"), "_gone": F.lit("y"), "_doc": F.lit("z"), "_th": F.lit("w")})
    out = ld.dedup_lines(docs, count_col="removed")
    assert out.columns == [*docs.columns, "removed"]
    assert {tuple(r)[:2] + tuple(r)[-5:] for r in out.collect()} == {(1, "a line\nanother", "x", "y", "z", "w", 0), (2, "", "x", "y", "z", "w", 1)}
    assert ld.dedup_lines(docs).columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]


def test_words_are_those_of_split():
    import numpy as np
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "é", " ", "\x1c", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "\n", "x"]
    owner, number, _, _, lens, starts, ends, _ = ld.line_hashes(texts)
    want = [(i, j, line.split()) for i, t in enumerate(texts) for j, line in enumerate((t or "").encode().split(b"\n")) if line.split()]
    assert list(zip(owner.tolist(), number.tolist(), lens.tolist())) == [(i, j, len(w)) for i, j, w in want]
    hashes = ld.word_hashes(np.frombuffer(b"\n".join((t or "").encode() for t in texts), np.uint8))[1].tolist()
    words = [w for _, _, line in want for w in line]
    assert len(hashes) == len(words) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
