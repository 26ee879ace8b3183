"""The pipeline against brute-force versions of its stages, and the registered queries."""
import hashlib
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from claimwise.llm import quality as ql
from claimwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_decontam import brute as contaminated
    from test_line_dedup import brute as lines
    from test_near_dedup import brute as near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        path = cp.materialize(stage(spark, docs, SF), "test-stage")
        assert path.columns == columns
        kept[name], docs = path.collect(), path
    texts = lambda rows: [(r["doc_id"], r["text"]) for r in rows]

    quality = kept["quality classifier"]
    bad = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    ids = {r["doc_id"] for r in quality}
    assert len(good & ids) >= 0.95 * len(good) and len(bad & ids) <= 0.2 * len(bad) and len(before) > len(quality)

    want = [(i, t) for i, t, n in lines(texts(quality)) if not (n and not t.strip())]
    assert sorted(texts(kept["line dedup"])) == sorted(want)
    want = [i for i, _, _, k in near(want, 5) if k]
    assert sorted(r["doc_id"] for r in kept["MinHash near-dedup"]) == sorted(want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in contaminated(texts(kept["MinHash near-dedup"]), items) if r[5]}
    last = kept["benchmark decontamination"]
    assert sorted(r["doc_id"] for r in last) == sorted(set(want) - dirty)
    done = {r["doc_id"]: r for r in cp.STAGES[-1][1](spark, docs, SF).collect()}
    assert {i: r["decoded_sha256"] for i, r in done.items()} == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in last}


def test_run_and_entry(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert names["pipeline"](spark, SF).count() > 0


def test_held_out_rule(spark):
    rows = spark.range(200).withColumn("x", ql.held_out(F.col("id"))).collect()
    assert all(r["x"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_queries_equal_their_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        rows = QUERIES[name](spark, SF)
        want = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({sql})").fetchall()
        assert sorted((tuple(r) for r in rows.collect()), key=repr) == sorted(want, key=repr), name


def test_stages_on_odd_tables(spark, documents):
    """Empty tables, and columns named like those that the stages make."""
    extra = {"n_removed": F.lit("x"), "gone": F.lit("y"), "_doc": F.lit("z"), "cls": F.lit(1), "bad": F.lit(2), "score": F.lit(3), "ids": F.lit(4)}
    rows = [(1, "The same line of this text, it is long enough to count.\nOne more."), (2, "The same line of this text, it is long enough to count."), (None, "No id here, but a text."), (3, None)]
    for table in ([], rows):
        docs = documents(table, extra)
        for name, stage in cp.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= len(table)
        assert cp.STAGES[-1][1](spark, docs, SF).count() == len(table)
        assert cp.STAGES[0][1](spark, docs, SF).columns == docs.columns
