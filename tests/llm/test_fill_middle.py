"""op13 against a direct version, and the exact way back."""
import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimwise.llm import fill_middle as fm

LONG = "word, " * 60_000
TEXTS = [(1, None), (2, ""), (3, "One two  three\n\nfour, 5."), (4, "x"), (5, "漢字 \U0001f642\U0001f44d\U0001f3fd été $1 \\2 {3}"), (6, "holds <S> already"),
         (7, LONG), (8, "a" * 200_000), (3, "One two  three\n\nfour, 5."), (None, "no id at all"), (9, "<<P>P>"), (10, "<P<S"), (11, "\r\n\t\x00\x0b end"), (-12, "minus one")]


def direct(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(docs):
    out = fm.fill_in_middle(docs)
    return out.withColumn("back", fm.restore(F.col("output"), F.col("form")))


def test_equals_direct_version(documents):
    rows = TEXTS + [(100 + i, f"Document {i}: some words <, and > more {'<M' if i % 7 == 0 else ''} text {i * i}.\n" * (i % 5 + 1)) for i in range(150)]
    got = rows_of(documents(rows, {"form": F.lit("clash"), "n": F.lit(1), "id": F.lit(2), "output": F.lit("x"), "parts": F.lit(0)})).collect()
    want = [direct(i, t) for i, t in rows]
    assert sorted(((r[0], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["back"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("aZ<>PSM $\\{}\né\U0001f642"), max_size=30), min_size=1, max_size=20))
def test_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in rows_of(docs).collect()}
    assert got == {i: (*direct(i, t)[1:], t) for i, t in enumerate(texts)}


def test_empty_table_and_plan(documents):
    df = rows_of(documents([]))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("percent", [0, 100])
def test_shares(documents, percent):
    got = fm.fill_in_middle(documents([(i, f"some text {i}") for i in range(40)]), fim_percent=100, spm_percent=percent).collect()
    assert {r["form"] for r in got} == {"psm" if percent == 0 else "spm"}
