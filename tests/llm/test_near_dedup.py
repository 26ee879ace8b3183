"""op1: components against all pairs of full sets."""
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimwise.llm import near_dedup as nd


def brute(rows, k):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(a)), i == least.get(find(a))) for a, (i, s) in enumerate(sets)), key=repr)


def texts(seed=3, groups=6, copies=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(60 + 20 * g)]
        out.append(" ".join(base))
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    out += [passage + " " + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(30)]
    return out


def result(docs, **options):
    return sorted((tuple(r) for r in nd.near_duplicates(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_all_pairs(documents, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    assert result(documents(rows), shingle_words=4) == brute(rows, 4)


def test_nulls_short_texts_repeats_and_extra_columns(documents):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five six"), (7, "one two three four five six"),
            (7, "one two three four five six"), (None, "one two three four five six"), (None, "alone is here now"), (9, "x" * 200_000), (10, "É é")]
    docs = documents(rows, {"cls": F.lit("clash"), "key": F.lit(1), "sig": F.lit(0)})
    assert result(docs, shingle_words=4) == brute(rows, 4)


def test_empty_table(documents):
    assert result(documents([])) == []


def test_one_group_holds_a_third_of_all_rows(documents):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j:])) for i, j in ((i, rng.randrange(80)) for i in range(150))]
    rows += [(1000 + i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.random()) for _ in range(50))) for i in range(300)]
    got = result(documents(rows))
    assert sum(kept for *_, kept in got) == 301


def test_drop_keeps_one_of_each_group_and_the_columns(documents):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "q r s t u v w x y"), (None, "m n o p q r"), (11, None)]
    docs = documents(rows)
    out = nd.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([2, 9, None, 11], key=repr)


def test_least_matches_bounds_the_posterior():
    for n, m in nd.least_matches(0.8, 96, 32, 1e-4):
        from math import comb
        tail = lambda k: sum(comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-4 > tail(m - 1)


def test_clashing_names_and_rows_without_an_id(documents):
    text = " ".join(f"word{i}" for i in range(40))
    near = text.replace("word39", "other")
    docs = documents([(1, text), (2, near), (None, text), (None, near), (None, "alone without an id at all"), (None, "alone without an id at all"), (3, "x"), (3, "x"), (4, None), (None, None)],
                     {"gone": F.lit("a"), "cls": F.lit("b"), "kept": F.lit("c")})
    out = nd.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["gone"], r["cls"]) for r in out.collect()), key=repr) == sorted(
        [(1, text, "a", "b"), *[(None, "alone without an id at all", "a", "b")] * 2, *[(3, "x", "a", "b")] * 2, (4, None, "a", "b"), (None, None, "a", "b")], key=repr)


def test_shuffled_ids_give_the_same(documents, monkeypatch):
    text = " ".join(f"word{i}" for i in range(40))
    docs = documents([(i, text if i % 3 else f"text number {i} of its own, with words") for i in range(30)])
    want = sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect()) == want and len(want) == 11
