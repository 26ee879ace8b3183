"""Hard negatives by exact integer scores from Kronecker-packed products.

Components become integers, floor(scale * x). For a block of candidate rows and each
component j, the rows' values, moved by a bias to be non-negative, lie in separate fields of
one wide integer W_j. For an anchor with components a_j the sum of a_j * W_j, one
multiplication per component, holds every candidate's inner product in the candidate's
field; a constant added to all fields keeps them non-negative, so none borrows from the next,
and the field width follows from the largest components of anchor and candidates. Bytes of
the sum are read back as numbers and the biases taken off: the scores are exact.

1. Usable rows are staged once with a number of their own. They are dealt by it into cells
   of bounded size, whatever ids, labels or vectors repeat; anchors are dealt into blocks the
   same way. Each (anchor block, cell) pair is one task's group, so the comparison is a grid
   of blocks: a row travels once per anchor block and an anchor once per cell.
2. Each group gives its best ``positives`` rows of the anchor's label; the best over all
   groups are the anchor's positives.
3. The anchors, now with the bounds that their positives' scores set, meet all cells again;
   each group gives, per positive, its best ``negatives`` rows of other labels within the
   bounds, and the best over all groups remain.

Rows with a null id, label or vector, or with any null or non-finite component, take no part.
Only vectors of one length are compared; empty ones have a score of 0 with each other. Every
row is a row of its own: of rows repeated under one id each is an anchor or a candidate, and
only the anchor's own row is not its candidate. Ties go to the smaller id. Other columns are
ignored, whatever their names. An empty table gives an empty result. A component of 2^62 or
more after scaling, or a score that does not fit a long, is an error.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_partitions, materialize

#: Largest group of the grid, and rows packed into one integer.
CELL_ROWS, ANCHOR_ROWS, PACKED_ROWS = 32_768, 32_768, 1_024
#: Anchors whose scores with one packed block are held at once.
SCORED_ANCHORS = 256
NONE = np.iinfo(np.int64).min


def usable_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v array<bigint>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter("id is not null and label is not null and x is not null").filter(finite)
            .select("id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    x = flat.reshape(len(column), dims)
    if x.size and max(int(x.max()), -int(x.min())) >= 1 << 62:
        raise ValueError("a scaled component of 2^62 or more")
    return x


class Packed:
    """A block of rows in one wide integer per component."""

    def __init__(self, rows: np.ndarray, largest: int):
        """``largest``: bound of the absolute components of the anchors to come."""
        self.count, dims = rows.shape
        self.bias = max(0, -int(rows.min(initial=0)))
        self.lift = max(1, dims * largest * (self.bias + max(0, int(rows.max(initial=0)))))    # no sum is below -lift or above lift
        self.width = ((2 * self.lift).bit_length() + 7) // 8
        moved = (rows.astype(np.uint64) + np.uint64(self.bias)).T         # below 2^63
        low = np.ascontiguousarray(moved).astype("<u8").view(np.uint8).reshape(dims, self.count, 8)
        fields = np.zeros((dims, self.count, self.width), np.uint8)
        fields[:, :, :min(8, self.width)] = low[:, :, :self.width]
        self.wide = [int.from_bytes(f.tobytes(), "little") for f in fields]
        self.base = int.from_bytes(self.lift.to_bytes(self.width, "little") * self.count, "little")

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, one line per anchor."""
        size = self.width * self.count
        body = b"".join(sum(map(mul, a, self.wide), self.base).to_bytes(size, "little") for a in anchors.tolist())
        fields = np.frombuffer(body, np.uint8).reshape(len(anchors), self.count, self.width)
        if self.width == 4:
            out = fields.reshape(len(anchors), -1).view("<u4").astype(np.uint64)
        else:
            low = np.zeros((len(anchors), self.count, 8), np.uint8)
            low[:, :, :min(8, self.width)] = fields[:, :, :8]
            out = low.view("<u8").reshape(len(anchors), self.count).astype(np.uint64)
        added = [(self.lift + self.bias * sum(a)) % (1 << 64) for a in anchors.tolist()]
        return (out - np.array(added, np.uint64)[:, None]).view(np.int64)     # modulo 2^64, right for every score that fits


def _check_range(anchors: np.ndarray, rows: np.ndarray) -> None:
    bound = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if anchors.shape[1] * bound(anchors) * bound(rows) < 1 << 63:
        return
    for at in range(0, len(anchors), SCORED_ANCHORS):
        if np.abs(anchors[at:at + SCORED_ANCHORS].astype(np.float64) @ rows.T.astype(np.float64)).max() > 9.2e18:
            raise ValueError("a score does not fit a long")


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Columns of each line's k highest allowed scores, the first ones of equals; -1 where there are fewer."""
    masked = np.where(allowed, scores, NONE)
    line, out = np.arange(len(scores)), np.full((len(scores), k), -1, np.int64)
    left = allowed.sum(axis=1)
    for i in range(min(k, scores.shape[1])):
        at = masked.argmax(axis=1)
        out[:, i] = np.where(left > i, at, -1)
        masked[line, at] = NONE
    return out


def _blocks(anchors: pa.Table, rows: pa.Table):
    """(anchor indices, row ids, labels, numbers, scores) of one group; rows by ascending id."""
    if not anchors.num_rows or not rows.num_rows:
        return
    dims = len(anchors["v"][0])
    a, r = _matrix(anchors["v"], dims), _matrix(rows["v"], dims)
    _check_range(a, r)
    ids, labels, numbers = (rows[c].to_numpy() for c in ("id", "label", "row"))
    order = np.lexsort((numbers, ids))
    largest = max(int(a.max(initial=0)), -int(a.min(initial=0)))
    for at in range(0, len(order), PACKED_ROWS):
        take = order[at:at + PACKED_ROWS]
        packed = Packed(r[take], largest)
        for first in range(0, len(a), SCORED_ANCHORS):
            who = np.arange(first, min(first + SCORED_ANCHORS, len(a)))
            yield who, ids[take], labels[take], numbers[take], packed.scores(a[who])


def _kept(parts: list, k: int) -> list[np.ndarray]:
    """The k best (key, id, score) of each key over the blocks of a group."""
    key, ids, score = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    # ~x falls as x rises and, other than -x, exists for every long
    order = np.lexsort((ids, ~score, key))
    key, ids, score = key[order], ids[order], score[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return [c[place < k] for c in (key, ids, score)]


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        parts = []
        for who, ids, labels, numbers, scores in _blocks(anchors, rows):
            at = best(scores, (labels[None, :] == label[who, None]) & (numbers[None, :] != own[who, None]), k)
            line, _ = np.nonzero(at >= 0)
            col = at[at >= 0]
            parts.append((who[line], ids[col], scores[line, col]))
        key, ids, score = _kept(parts, k)
        return pa.table({"row": pa.array(own[key], pa.int64()), "positive_id": pa.array(ids, pa.int64()), "positive_score": pa.array(score, pa.int64())})
    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        label = anchors["label"].to_numpy()
        bars = [[(low * s, high * s) for s in x] for x in anchors["scores"].to_pylist()]
        slots = max(map(len, bars), default=1)
        # a score s is within the bounds if ceil(low p / 100) <= s <= floor(high p / 100)
        floor = np.full((len(bars), slots), np.iinfo(np.int64).max)
        ceiling = np.full((len(bars), slots), NONE)
        for i, x in enumerate(bars):
            for j, (lo, hi) in enumerate(x):
                floor[i, j], ceiling[i, j] = -(-lo // 100), hi // 100
        parts = []
        for who, ids, labels, _, scores in _blocks(anchors, rows):
            other = labels[None, :] != label[who, None]
            for j in range(slots):
                at = best(scores, other & (scores >= floor[who, j, None]) & (scores <= ceiling[who, j, None]), k)
                line, _ = np.nonzero(at >= 0)
                col = at[at >= 0]
                parts.append((who[line] * slots + j, ids[col], scores[line, col]))
        key, ids, score = _kept(parts, k)
        return pa.table({"row": pa.array(anchors["row"].to_numpy()[key // slots], pa.int64()), "slot": pa.array(key % slots, pa.int32()),
                         "negative_id": pa.array(ids, pa.int64()), "negative_score": pa.array(score, pa.int64())})
    return run


def _first(df: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str) -> DataFrame:
    """The k first rows of each key; a group gives at most k, so a key has k rows per cell."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def mine(vectors: DataFrame, is_anchor, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         cell_rows: int | None = None, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor,
    a row for which ``is_anchor(id)`` holds, and each of its first ``positives`` rows of its label,
    the first ``negatives`` rows of other labels with low * p <= 100 * score <= high * p."""
    spark = vectors.sparkSession
    good = usable_rows(vectors, label if label is not None else F.col(label_col), id_col, vector_col, scale)
    rows = materialize(good.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    total = rows.count()
    size = cell_rows or min(CELL_ROWS, max(PACKED_ROWS, -(-total // (3 * default_partitions(spark)))))
    cells = max(1, -(-total // size))
    anchors = materialize(rows.filter(is_anchor(F.col("id"))), "negatives-anchors")
    blocks = max(1, -(-anchors.count() // anchor_rows))

    dealt = lambda df, name, n, salt: df.withColumn(name, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int"))
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = ["block", "cell", F.size("v")]
    table = each(dealt(rows, "cell", cells, 1), "block", blocks).groupBy(*key)
    grid = lambda df, fn, schema: each(dealt(df, "block", blocks, 2), "cell", cells).groupBy(*key).cogroup(table).applyInArrow(fn, schema)

    found = grid(anchors, _positives(positives), "row bigint, positive_id bigint, positive_score bigint")
    pairs = materialize(_first(found, ["row"], "positive_score", "positive_id", positives, "slot"), "negatives-positives")
    bars = pairs.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    bounded = anchors.join(bars, "row")
    found = grid(bounded, _negatives(negatives, low, high), "row bigint, slot int, negative_id bigint, negative_score bigint")
    ranked = _first(found, ["row", "slot"], "negative_score", "negative_id", negatives, "rank")
    named = anchors.select("row", F.col("id").alias("anchor_id")).join(pairs, "row").withColumn("slot", F.col("slot") - 1)
    return ranked.join(named, ["row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
