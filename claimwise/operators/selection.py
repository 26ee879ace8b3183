"""Exact order statistics without a sort.

One scan gives, per group, a quantile sketch on a fine grid; its error is known, so two grid
values bracket the row of any wanted rank. A second scan counts: rows outside all brackets per
interval between them, rows inside by value. Ranks then follow from a few counts. A group's hot
values are one row of counts each, whatever their number of rows, and nothing that is held grows
with the rows: groups are limited to ``MAX_GROUPS`` and counts to ``MAX_CELLS``; beyond either
``None`` is returned and the caller takes its distributed path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID, ACCURACY = 400, 2_000
MAX_GROUPS, MAX_CELLS = 64, 200_000
#: Plan nodes that cost no more than reading their input again.
_CHEAP = {"Project", "Filter", "Relation", "LogicalRelation", "Expand", "Union", "LocalRelation", "SubqueryAlias"}


def is_scan(df: DataFrame) -> bool:
    """The plan only reads, projects and filters: several passes need no staging."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    return all(line.lstrip(" :+-").split(" ")[0].split("[")[0].split("(")[0] in _CHEAP for line in lines)


@dataclass
class Cell:
    """Rows of a group between two brackets (``value`` None) or with one value inside a bracket."""
    index: int
    value: object
    rows: int


def constant(value, kind: str) -> Column:
    """A nested constant of a SQL type. Catalyst folds it to one object, so the generated code does
    not depend on the values and is compiled once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def group_index(names: Sequence[str], keys: list[tuple]) -> Column:
    """Place of the row's group in ``keys``, null for other rows."""
    out = F.lit(None).cast("int")
    for i, key in enumerate(keys):
        here = F.lit(True)
        for n, v in zip(names, key):
            here = here & F.col(n).eqNullSafe(F.lit(v))
        out = F.when(here, i).otherwise(out)
    return out


def sketches(df: DataFrame, value: Column, group_cols: Sequence[str]) -> list | None:
    """One row per group with ``_n`` (values) and ``_grid`` (their sketch); null values are left out."""
    probs = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))
    rows = df.select(*group_cols, value.alias("_x")).groupBy(*group_cols).agg(
        F.count("_x").alias("_n"), F.expr(f"percentile_approx(_x, array({probs}), {ACCURACY})").alias("_grid")).limit(MAX_GROUPS + 1).collect()
    return rows if len(rows) <= MAX_GROUPS else None


def bracket(n: int, grid: list | None, rank: int) -> tuple:
    """Values (lo, hi), None for no bound, that hold the value of the 0-based rank between them."""
    if n <= 1 or not grid:
        return None, None
    low, high = rank * GRID // (n - 1) - 1, -(-rank * GRID // (n - 1)) + 1
    return (grid[low] if low > 0 else None), (grid[high] if high < GRID else None)


def merged(brackets: list[tuple]) -> list[tuple]:
    """Brackets in order, overlapping ones as one."""
    key = lambda b: (b[0] is not None, b[0] if b[0] is not None else 0)
    out: list[list] = []
    for lo, hi in sorted(brackets, key=key):
        if out and (out[-1][1] is None or lo is None or lo <= out[-1][1]):
            if out[-1][1] is not None and (hi is None or hi > out[-1][1]):
                out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tuple(b) for b in out]


_LEAST = {"double": float("-inf"), "bigint": -(1 << 63)}


def cell_index(value: Column, group: Column, brackets: list[list[tuple]], kind: str = "double") -> Column:
    """2m + 1 inside bracket m of the row's group, 2m before it."""
    low = constant([[_LEAST[kind] if lo is None else lo for lo, _ in b] for b in brackets], f"array<array<{kind}>>")
    high = constant([[hi for _, hi in b if hi is not None] for b in brackets], f"array<array<{kind}>>")
    return F.size(F.filter(low[group], lambda x: value >= x)) + F.size(F.filter(high[group], lambda x: value > x))


def counts(df: DataFrame, value: Column, group: Column, brackets: list[list[tuple]], kind: str = "double") -> list[list[Cell]] | None:
    """Cells of each group (a place in ``brackets``) in the order of values, by one scan."""
    if not brackets:
        return []
    tagged = df.select(value.alias("_x"), group.alias("_g")).where("_x is not null and _g is not null")
    tagged = tagged.withColumn("_i", cell_index(F.col("_x"), F.col("_g"), brackets, kind)).withColumn("_v", F.when(F.col("_i") % 2 == 1, F.col("_x")))
    rows = tagged.groupBy("_g", "_i", "_v").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        return None
    out: list[list[Cell]] = [[] for _ in brackets]
    for r in rows:
        out[r["_g"]].append(Cell(r["_i"], r["_v"], r["_n"]))
    for cells in out:
        cells.sort(key=lambda c: (c.index, c.value if c.value is not None else 0))
    return out


def at_rank(cells: list[Cell], rank: int) -> tuple | None:
    """(value, rows below it, rows with it) of the 0-based rank; None if the rank lies outside the brackets."""
    below = 0
    for c in cells:
        if rank < below + c.rows:
            return (c.value, below, c.rows) if c.value is not None else None
        below += c.rows
    return None


def between(cells: list[Cell], n: int, prob: float):
    """Quantile with linear interpolation between the two neighbouring order statistics."""
    pos = (n - 1) * prob
    lo = int(pos)
    a, b = at_rank(cells, lo), at_rank(cells, min(n - 1, lo + (pos > lo)))
    if a is None or b is None:
        raise ArithmeticError("a sketch did not bracket its rank")
    lo_v, hi_v = a[0], b[0]
    return lo_v if pos == lo or lo_v == hi_v else (lo + 1 - pos) * lo_v + (pos - lo) * hi_v


def ranks_of(n: int, prob: float) -> list[int]:
    pos = (n - 1) * prob
    return sorted({int(pos), min(n - 1, int(pos) + (pos > int(pos)))})


def quantiles(df: DataFrame, value: Column, group_cols: Sequence[str], probs: Callable[[tuple], Sequence[float]]) -> dict | None:
    """{group: {prob: quantile}} in two scans; groups without values are left out."""
    g = list(group_cols)
    rows = sketches(df, value, g)
    if rows is None:
        return None
    rows = [r for r in rows if r["_n"]]
    keys = [tuple(r[c] for c in g) for r in rows]
    wanted = [list(probs(k)) for k in keys]
    found = counts(df, value, group_index(g, keys), [merged([bracket(r["_n"], r["_grid"], i) for p in ps for i in ranks_of(r["_n"], p)]) for r, ps in zip(rows, wanted)])
    if found is None:
        return None
    return {k: {p: between(cells, r["_n"], p) for p in ps} for k, r, ps, cells in zip(keys, rows, wanted, found) if ps}
