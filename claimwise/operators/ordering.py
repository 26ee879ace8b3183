"""Global order without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` funnels every row into one task.
The helpers here keep the work distributed:

* ``global_row_number``: range-partition on the sort key (ties split across
  partitions because the key includes a unique tiebreaker), sort inside each
  partition, tag rows with ``monotonically_increasing_id`` (partition index in
  the high bits, position in the low 33 bits), materialise once, then add the
  per-partition offsets (one row per partition, so the broadcast is bounded by
  the partition count).
* ``prefix_sums``: the same partitioning; running sums are made inside the write
  of the range-partitioned rows, so rows are shuffled once, and the totals of the
  preceding partitions are added on reading; optionally restarted per group.
* ``exact_quantiles``: NumPy/Spark ``percentile`` semantics (linear
  interpolation) by selection (``selection``), or from a value-count table and its
  prefix sums, so no task ever holds more than its range partition of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_partitions, materialize
from . import selection

_LOW_BITS = (1 << 33) - 1
MAX_LOOP_GROUPS = 64      # per-group constant-probability aggregates; beyond this, one distributed pass


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _partition_offsets(sizes: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """Exclusive running totals over partitions. ``sizes`` has one row per
    partition, so this tiny window is bounded by the partition count."""
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_pid", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in value_cols])


def global_row_number(df: DataFrame, order_cols: Sequence, out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the total order ``order_cols``.

    ``order_cols`` must make the order total (append the key, e.g. IDpol), so
    equal scores are split by the key instead of piling into one partition.
    """
    spark = df.sparkSession
    p = num_partitions or default_partitions(spark)
    order = _cols(order_cols)
    tagged = (df.repartitionByRange(p, *order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "rank")
    pid = F.shiftrightunsigned(F.col("_mid"), 33)
    sizes = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _partition_offsets(sizes, ["_n"])
    # broadcast bound: one row per range partition
    joined = tagged.join(F.broadcast(offsets), pid == offsets["_pid"])
    rn = (F.col("_off__n") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + F.lit(1)).alias(out)
    return joined.select(*[tagged[c] for c in df.columns], rn)


#: Rows of an offset table that is broadcast (partitions + groups).
MAX_OFFSETS = 100_000


def _running(groups: int, sums: Sequence[int]):
    """Batches of sorted rows in; the same with a running sum per column, restarted where a group changes."""
    def run(batches):
        before, carry = None, [0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in range(groups):
                code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(c)[0].as_py() for c in range(groups))
            new[0] = before is not None and first != before
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            fresh = np.maximum.accumulate(new)          # a group began in this batch
            out = []
            for k, c in enumerate(sums):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                total = total - np.where(fresh, total[start] - x[start], 0) + np.where(fresh, 0, carry[k]).astype(total.dtype)
                carry[k] = total[-1]
                out.append(pa.array(total))
            before = tuple(batch.column(c)[n - 1].as_py() for c in range(groups))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"_loc{k}" for k in range(len(sums))]])
    return run


def prefix_sums(df: DataFrame, order_cols: Sequence, sum_cols: Sequence[str],
                group_cols: Sequence[str] = (), prefix: str = "cum_",
                num_partitions: int | None = None, by_key: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` (whole or floating numbers without nulls) in
    ``order_cols`` order, restarting at each ``group_cols`` value. The order must be total within
    a group for the result to be deterministic.

    Rows are range-partitioned on (group, order) and sorted, their running sums are made on the
    way into the staged files; each (partition, group) piece then gets the total of its group in
    earlier partitions. That offset table has at most partitions + groups rows (broadcast up to
    ``MAX_OFFSETS`` rows), and a hot group spanning many partitions is split by partition.
    ``by_key``: rows that share (group, order) values are first added up: in their batch before the shuffle,
    and after it, where they meet in one partition."""
    spark = df.sparkSession
    p = num_partitions or default_partitions(spark)
    g, names = list(group_cols), list(df.columns)
    order = [*_cols(g), *_cols(order_cols)]
    if by_key:
        keys = [c for c in names if c not in sum_cols]
        df = df.select(*keys, *sum_cols)
        names = df.columns
        rows = df.mapInArrow(_combined(len(keys), len(sum_cols)), df.schema).repartitionByRange(p, *order)
        rows = rows.groupBy(*keys).agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c) for c in sum_cols])
    else:
        rows = df.repartitionByRange(p, *order)
    others = [c for c in names if c not in g]
    sorted_ = rows.select(*g, *others).sortWithinPartitions(*order)
    at = [len(g) + others.index(c) for c in sum_cols]
    running = {c: "bigint" if sorted_.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for c in sum_cols}
    sorted_ = sorted_.select(*g, *[F.col(c).cast(running[c]) if c in running else F.col(c) for c in others])
    schema = T.StructType([*sorted_.schema.fields, *[T.StructField(f"_loc{k}", T.LongType() if running[c] == "bigint" else T.DoubleType()) for k, c in enumerate(sum_cols)]])
    tagged = materialize(sorted_.mapInArrow(_running(len(g), at), schema).withColumn("_pid", F.spark_partition_id()), "prefix")
    # a piece's total is its last running sum; sums that may fall (negative values) are added up anew
    sizes = tagged.groupBy("_pid", *g).agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sum_cols)])
    listed = sizes.limit(MAX_OFFSETS + 1).collect()
    if len(listed) > MAX_OFFSETS:
        wo = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = materialize(sizes, "prefix-sizes").select("_pid", *g, *[F.coalesce(F.sum(f"_t{k}").over(wo), F.lit(0)).alias(f"_off{k}") for k in range(len(sum_cols))])
    else:
        done: dict[tuple, list] = {}
        offs = []
        for r in sorted(listed, key=lambda r: r["_pid"]):
            so_far = done.setdefault(tuple(r[c] for c in g), [0] * len(sum_cols))
            offs.append((r["_pid"], *[r[c] for c in g], *so_far))
            for k in range(len(sum_cols)):
                so_far[k] += r[f"_t{k}"]
        kinds = T.StructType([T.StructField("_pid", T.IntegerType()), *[tagged.schema[c] for c in g],
                              *[T.StructField(f"_off{k}", schema[f"_loc{k}"].dataType) for k in range(len(sum_cols))]])
        offs = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None and f.name.startswith("_off") else v for v, f in zip(o, kinds.fields)) for o in offs]
        offsets = F.broadcast(spark.createDataFrame(offs, kinds))
    # _pid is never null: plain equality keeps it a join key; groups may be null
    joined = tagged.join(offsets, [tagged["_pid"] == offsets["_pid"], *[tagged[k].eqNullSafe(offsets[k]) for k in g]])
    return joined.select(*[tagged[c] for c in names], *[(F.col(f"_off{k}") + F.col(f"_loc{k}")).alias(f"{prefix}{c}") for k, c in enumerate(sum_cols)])


def _combined(keys: int, sums: int):
    """Batches in; each batch with one row per key, its last ``sums`` columns added up."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                t = pa.Table.from_batches([batch]).group_by(names[:keys]).aggregate([(c, "sum") for c in names[keys:]])
                t = t.select([*names[:keys], *[f"{c}_sum" for c in names[keys:]]]).rename_columns(names).cast(batch.schema)
                yield from t.combine_chunks().to_batches()
    return run


def exact_quantiles(df: DataFrame, value: str, probs,
                    group_cols: Sequence[str] = (), method: str = "auto",
                    max_buffered_distinct: int = 200_000) -> DataFrame:
    """(group..., prob, quantile) with linear interpolation (NumPy default,
    Spark ``percentile``, DuckDB ``quantile_cont``). Nulls/NaN ignored.

    method:
      "buffered"    Spark's ``percentile`` aggregate: one pass, but the final
                    merge of a group holds all its distinct values.
      "distributed" selection in two scans; many groups, or brackets with very many
                    values: as "sorted".
      "sorted"      value counts -> range-partitioned prefix sums -> lookup:
                    no task holds more than a range slice.
      "approx"      ``percentile_approx`` (bounded sketch, not exact).
      "auto"        "buffered" if the column has few distinct values
                    (HyperLogLog estimate), else "distributed".

    ``probs`` is a list of constants, or a DataFrame ``(group..., prob)`` of
    data-dependent probabilities (one per group, e.g. 1 - claim rate).

    ``group_cols`` name caller-bounded groups (models, variables, claim
    classes): the distributed path broadcasts one lookup row per group and
    probability, while the rows of any group - however hot - stay spread.
    """
    g = list(group_cols)
    v = F.col(value)
    clean = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    prob_table = probs if isinstance(probs, DataFrame) else None
    if method == "auto":
        est = clean.agg(F.approx_count_distinct(v).alias("d")).first()["d"]
        method = "buffered" if est <= max_buffered_distinct else "distributed"
    if prob_table is not None and method in ("buffered", "approx"):
        # a constant percentage per aggregate: one small job per group
        rows = prob_table.limit(MAX_LOOP_GROUPS + 1).collect()
        if len(rows) > MAX_LOOP_GROUPS:
            method = "distributed"
        else:
            out = None
            for r in rows:
                cond = F.lit(True)
                for k in g:
                    cond = cond & F.col(k).eqNullSafe(F.lit(r[k]))
                part = exact_quantiles(clean.where(cond), value, [r["prob"]], [], method)
                part = part.select(*[F.lit(r[k]).alias(k) for k in g], "prob", "quantile")
                out = part if out is None else out.unionByName(part)
            return out if out is not None else prob_table.select(*g, "prob", F.lit(None).cast("double")
                                                                 .alias("quantile")).limit(0)
    probs = [] if prob_table is not None else [float(x) for x in probs]
    if method in ("buffered", "approx"):
        arr = F.array(*[F.lit(x) for x in probs])
        if method == "buffered":
            agg = F.percentile(v.cast("double"), arr)
        else:
            agg = F.percentile_approx(v.cast("double"), arr, 10000).cast("array<double>")
        res = clean.groupBy(*g).agg(agg.alias("_q"))
        return res.select(*g, F.posexplode("_q").alias("_i", "quantile")).select(
            *g, F.element_at(F.array(*[F.lit(x) for x in probs]), F.col("_i") + 1).alias("prob"), "quantile")
    if method not in ("distributed", "sorted"):
        raise ValueError(method)
    if method == "distributed":
        found = _selected(clean, v, probs, prob_table, g)
        if found is not None:
            return found
    counts = clean.groupBy(*g, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(counts, ["_v"], ["_n"], group_cols=g)
    totals = counts.groupBy(*g).agg(F.sum("_n").alias("_N"))
    if prob_table is not None:
        per = totals.join(prob_table.select(*g, F.col("prob").cast("double").alias("prob")), g) if g else \
            totals.withColumn("prob", prob_table.select(F.col("prob").cast("double")).scalar())
    else:
        per = totals.select(*g, "_N", F.explode(F.array(*[F.lit(x) for x in probs])).alias("prob"))
    targets = per \
        .withColumn("_pos", (F.col("_N") - 1) * F.col("prob")) \
        .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    if not g:
        # ungrouped: the wanted order statistics are a handful of literal
        # positions, so a filter finds them (no join at all)
        want = targets.where(F.col("_N").isNotNull()).collect()   # one row per probability; none without values
        ks = sorted({int(r[c]) for r in want for c in ("_lo", "_hi")})
        hit = F.lit(False)
        for k in ks:
            hit = hit | ((F.col("cum__n") - F.col("_n") <= k) & (F.lit(k) < F.col("cum__n")))
        found = cum.where(hit).select("_v", "_n", "cum__n").collect()   # at most len(ks) rows

        def value_at(k):
            for r in found:
                if r["cum__n"] - r["_n"] <= k < r["cum__n"]:
                    return r["_v"]
            return None
        out = []
        for r in want:
            lo, hi, pos = int(r["_lo"]), int(r["_hi"]), r["_pos"]
            vlo, vhi = value_at(lo), value_at(hi)
            q = vlo if (hi == lo or vhi == vlo) else (hi - pos) * vlo + (pos - lo) * vhi
            out.append((float(r["prob"]), q))
        return df.sparkSession.createDataFrame(out, "prob double, quantile double")

    # the k-th (0-based) value is the row whose count interval [cum - n, cum) holds k
    def at(kcol: str, name: str) -> DataFrame:
        t = targets.alias("t")
        c = cum.alias("c")
        cond = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in g] + [
            (F.col("c.cum__n") - F.col("c._n") <= F.col(f"t.{kcol}")), (F.col(f"t.{kcol}") < F.col("c.cum__n"))]
        # targets has groups x probs rows: broadcast keeps the big side in place
        return c.join(F.broadcast(t), cond).select(*[F.col(f"t.{k}") for k in g], F.col("t.prob"),
                                                   F.col("c._v").alias(name))
    lo = at("_lo", "_vlo")
    hi = at("_hi", "_vhi")
    res = targets.join(lo, [*g, "prob"]).join(hi, [*g, "prob"])
    q = F.when((F.col("_hi") == F.col("_lo")) | (F.col("_vhi") == F.col("_vlo")), F.col("_vlo")).otherwise(
        (F.col("_hi") - F.col("_pos")) * F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * F.col("_vhi"))
    return res.select(*g, "prob", q.alias("quantile"))


def _selected(clean: DataFrame, v: Column, probs: list, prob_table: DataFrame | None, g: list[str]) -> DataFrame | None:
    """The quantiles by selection, as a small table; None beyond its limits."""
    wanted = None
    if prob_table is not None:
        rows = prob_table.select(*g, F.col("prob").cast("double").alias("prob")).limit(selection.MAX_GROUPS * 16 + 1).collect()
        if len(rows) > selection.MAX_GROUPS * 16:
            return None
        wanted = {}
        for r in rows:
            wanted.setdefault(tuple(r[c] for c in g), []).append(r["prob"])
    found = selection.quantiles(clean, v.cast("double"), g, lambda key: probs if wanted is None else wanted.get(key, []))
    if found is None:
        return None
    out = [(*key, float(p), q) for key, ps in found.items() for p, q in ps.items()]
    schema = T.StructType([*[clean.schema[c] for c in g], T.StructField("prob", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    return clean.sparkSession.createDataFrame(out, schema)


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], **kw) -> list[float]:
    """Global (ungrouped) quantiles as Python floats: a handful of scalars."""
    rows = exact_quantiles(df, value, probs, **kw).collect()
    found = {float(r["prob"]): r["quantile"] for r in rows}
    return [found.get(float(p)) for p in probs]
