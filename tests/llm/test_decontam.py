"""op2: hit words against a direct search for every window."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwise.llm import decontam as dc


def brute(rows, items, window=13):
    out = []
    for i, t in rows:
        w = dc.words_of(t)
        whole = b" ".join(w)
        hit, names = set(), set()
        for name, text in items:
            q = dc.words_of(text)
            k = min(window, len(q))
            for p in range(len(q) - k + 1 if k else 0):
                if b" ".join(q[p:p + k]) not in whole:
                    continue
                for a in range(len(w) - k + 1):
                    if w[a:a + k] == q[p:p + k]:
                        hit.update(range(a, a + k))
                        names.add("null" if name is None else str(name))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r)[:6] for r in dc.verdicts(df).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def corpus(rng):
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 13, 14, 30])))) for k in range(12)] + [(3, "w1 w2"), (None, "w5 w6 w7 w8"), (50, None), (51, "--")]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            q = rng.choice(items[:12])[1].upper().split()
            a = rng.randrange(len(w) + 1)
            w[a:a] = q if i % 2 else q[:13]
        rows.append((i, ", ".join(w)))
    return rows + [(100, None), (101, ""), (7, "same id"), (None, items[4][1]), (None, items[4][1]), (102, "é " + items[1][1] + " É")], items


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_chars": 200}])
def test_equals_direct_search(spark, documents, options):
    rows, items = corpus(random.Random(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows, {"row": F.lit(0), "id": F.lit("clash"), "spans": F.lit(1)})
    assert rows_of(dc.matches(docs, bench, **options)) == brute(rows, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(dc.matches(documents([(1, "a b")]), none)) == brute([(1, "a b")], [])
    assert rows_of(dc.matches(documents([]), none)) == []


def test_longest_match_and_its_place(spark, documents):
    item = " ".join(f"q{i}" for i in range(20))
    got = dc.matches(documents([(1, "x y " + item + " z " + " ".join(item.split()[:15]))]), spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in got["matches"]] == [("8", 20, 0, 2)] and [tuple(s) for s in got["spans"]] == [(2, 22), (23, 38)]


def test_decontaminate_keeps_clean_rows(spark, documents):
    item = " ".join(f"q{i}" for i in range(20))
    docs = documents([(1, item), (2, "clean text"), (3, "a " * 2000 + item), (4, None)])
    out = dc.decontaminate(docs, spark.createDataFrame([(8, item)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r[0] for r in out.collect()) == [2, 3, 4]


@pytest.mark.parametrize("options", [{}, {"block_chars": 40}])
def test_decontaminate_judges_each_row_by_its_own_text(spark, documents, options):
    item = " ".join(f"q{i}" for i in range(20))
    docs = documents([(None, item), (None, "clean text"), (None, None), (1, item), (1, "other clean text")], {"place": F.lit(0), "bad": F.lit("clash"), "bad_th": F.lit(1)})
    out = dc.decontaminate(docs, spark.createDataFrame([(8, item)], "item_id long, text string"), **options)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(None, "clean text"), (None, None), (1, "other clean text")], key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_order(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 3 if seed else 1, 200)
    order = dc.suffix_array(t, 20)
    padded = np.concatenate([t, np.zeros(20, np.int64)])
    heads = [tuple(padded[i:i + 20]) for i in order]
    assert sorted(order) == list(range(200)) and heads == sorted(heads)
