"""Benchmark decontamination by suffix arrays over the training texts.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters. Each task
gathers its documents into shards of about ``shard_words`` words, builds the
shard's suffix array (prefix doubling over word ids, deep enough for the longest
item) and finds each suffix of each benchmark item in it by binary search: the
range of suffixes that begin with the item's next ``window`` words, their places,
and how far each match goes on verbatim. An item with fewer words than a window is
one window itself.

Documents are whole within a shard, so a document's result needs no shuffle, and
a passage that a third of the documents share costs its occurrences alone. The
benchmark is read in blocks of bounded size; with several blocks the hit spans of
a document are merged by a shuffle on its row number.

Null texts have no words. Repeated items count once by their item_id; an item with
null id is listed as "null". Extra columns are ignored, whatever their names. Repeated
documents have equal results. A very long text is a shard of its own. An empty table gives an
empty result, an empty benchmark hits nothing. Input has to be a deterministic scan when there are several blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, materialize, strings

SHARD_WORDS = 500_000       # about 40 bytes each while a shard is searched
WINDOWS = 100_000           # windows searched at a time
BLOCK_CHARS = 64_000_000    # benchmark text that is broadcast at a time

#: ASCII: A-Z to a-z, digits and a-z kept, all else to a space; other bytes kept.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first ``depth`` tokens at least. ``tokens``: ids >= 0."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int32)
    bits = max(1, int(tokens.max()).bit_length())
    h = max(1, min(depth, 63 // bits))
    key = tokens.astype(np.int64)
    for i in range(1, h):
        key <<= bits
        key[:max(0, n - i)] |= tokens[i:]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), np.int32(0))) + 1
    while h < depth:
        alone = first & np.concatenate([first[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        pair = rank[at].astype(np.int64) * (n + 2) + rank[np.minimum(at.astype(np.int64) + h, n)]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        h *= 2
    return order


def find(tail: np.ndarray, order: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``order`` whose suffixes begin with each row of ``windows``, by binary
    search. ``tail``: the tokens and, after them, -1 for as many as a row is long."""
    n, w = len(order), windows.shape[1]
    offsets = np.arange(w, dtype=np.int32)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), n, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) >> 1
            there = tail[order[mid][:, None] + offsets]
            differs = there != windows[open_]
            at = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            equal = ~differs[rows, at]
            less = np.where(equal, upper, there[rows, at] < windows[open_][rows, at])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)

    return bound(False), bound(True)


class Shard:
    """Whole documents as word ids, gathered until they are searched together."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        new, index = self.index.setdefault, self.index
        self.texts.append(np.fromiter((new(w, len(index) + 1) for w in words), np.int32, len(words)))
        self.size += len(words) + 1

    def search(self, items: list[list[bytes]], window: int):
        """Per text: word count, hit spans [(start, end)), {item: (longest, item start, text start)}."""
        lens = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        starts = np.cumsum(lens + 1) - lens - 1
        tokens = np.zeros(int((lens + 1).sum()), np.int32)
        for s, text in zip(starts.tolist(), self.texts):
            tokens[s:s + len(text)] = text
        coded = [np.array([self.index.get(w, -1) for w in words], np.int32) for words in items]
        spans: list[list] = [[] for _ in self.texts]
        found: list[dict] = [{} for _ in self.texts]
        places: dict[int, list] = {}   # by window length: (item, first word) of the windows whose words the shard has
        for i, c in enumerate(coded):
            w = min(window, len(c))
            if w:
                known = np.concatenate([[0], np.cumsum(c >= 0)])
                at = np.flatnonzero(known[w:] - known[:-w] == w)
                places.setdefault(w, []).append(np.stack([np.full(len(at), i), at], axis=1))
        places = {w: np.concatenate(x) for w, x in places.items()}
        if not any(map(len, places.values())):
            return lens, spans, found
        depth = max(map(len, coded))
        order = suffix_array(tokens, depth)
        order = order[tokens[order] > 0]
        tail = np.concatenate([tokens, np.full(depth + 1, -1, np.int32)])
        for w, all_ in places.items():
            for part in (all_[x:x + WINDOWS] for x in range(0, len(all_), WINDOWS)):
                windows = np.array([coded[i][p:p + w] for i, p in part.tolist()], np.int32).reshape(len(part), w)
                low, high = find(tail, order, windows)
                for k in np.flatnonzero(high > low):
                    i, p = part[k].tolist()
                    at = np.sort(order[low[k]:high[k]]).astype(np.int64)
                    size = np.full(len(at), w, np.int64)
                    going = np.arange(len(at))
                    for q in range(p + w, len(coded[i])):
                        going = going[tail[at[going] + (q - p)] == coded[i][q]]
                        if not len(going):
                            break
                        size[going] += 1
                    doc = np.searchsorted(starts, at, side="right") - 1
                    for d, a, s in zip(doc.tolist(), (at - starts[doc]).tolist(), size.tolist()):
                        if spans[d] and spans[d][-1][0] <= a <= spans[d][-1][1]:
                            spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], a + s))
                        else:
                            spans[d].append((a, a + s))
                        if s > found[d].get(i, (0,))[0]:
                            found[d][i] = (s, p, a)
        return lens, spans, found


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("n_words", pa.int32()), ("item_start", pa.int32()), ("doc_start", pa.int32())]))
_SQL = "n_words bigint, spans array<struct<start:int,end:int>>, matches array<struct<item_id:string,n_words:int,item_start:int,doc_start:int>>"


def _scan(shared, window: int, shard_words: int):
    def run(batches):
        names, items = shared.value
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 33
        ids, rows, shard = [], [], Shard()

        def flush():
            lens, spans, found = shard.search(items, window)
            best: list[list] = []
            for f in found:
                by: dict[str, tuple] = {}
                for i, (s, p, a) in f.items():
                    if s > by.get(names[i], (0,))[0]:
                        by[names[i]] = (s, p, a)
                best.append([{"item_id": k, "n_words": s, "item_start": p, "doc_start": a} for k, (s, p, a) in sorted(by.items())])
            return pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.concat_arrays(ids), pa.array(lens, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in union(s)] for s in spans], _SPANS), pa.array(best, _MATCHES),
            ], names=["row", "id", "n_words", "spans", "matches"])

        for batch in batches:
            column = batch.column(1)
            for k in range(batch.num_rows):
                shard.add(words_of(column[k].as_py()))
                ids.append(pa.array([batch.column(0)[k].as_py()], batch.column(0).type))
                rows.append(row)
                row += 1
                if shard.size >= shard_words:
                    yield flush()
                    ids, rows, shard = [], [], Shard()
        if ids:
            yield flush()

    return giving_back(run)


def _merge(key, table):
    by: dict[str, dict] = {}
    for m in (m for part in table["matches"].to_pylist() for m in part):
        if m["n_words"] > by.get(m["item_id"], {"n_words": 0})["n_words"]:
            by[m["item_id"]] = m
    spans = union([(s["start"], s["end"]) for part in table["spans"].to_pylist() for s in part])
    return pa.table({"row": table["row"][:1], "id": table["id"][:1], "n_words": table["n_words"][:1],
                     "spans": pa.array([[{"start": a, "end": b} for a, b in spans]], _SPANS),
                     "matches": pa.array([[by[k] for k in sorted(by)]], _MATCHES)})


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
            shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, spans, matches): one row per document. ``spans``: the word ranges that
    windows hit; ``matches``: per item with a window in the document, its longest verbatim
    match there (words, first word in the item, first word in the document)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(strings(benchmark, "text"), F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    source = docs.select(F.col(id_col).alias("id"), strings(docs, text_col).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["id"], *T._parse_datatype_string(_SQL).fields])
    scans = []
    for block in range(blocks):
        held = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r[0], words_of(r[1])) for r in held.distinct().collect()]   # bounded by block_chars
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        scan = source.mapInArrow(_scan(shared, window, shard_words), schema)
        if blocks > 1:
            scan = materialize(scan, "dc-block")     # written before the next block is collected
            shared.destroy()
        scans.append(scan)
    out = scans[0]
    if blocks > 1:
        for p in scans[1:]:
            out = out.union(p)
        out = out.groupBy("row").applyInArrow(_merge, schema)
    return out.drop("row").withColumnRenamed("id", id_col)


def verdicts(found: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated): a document is contaminated
    when a word in ``share`` or more is hit."""
    n_hit = F.expr("cast(aggregate(spans, 0L, (acc, s) -> acc + (s.end - s.start)) as bigint)")
    items = F.expr("transform(matches, m -> m.item_id)")
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"),
        F.expr("transform(matches, m -> m.n_words)").alias("longest_words"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).withColumn(
        "longest_match", F.coalesce(F.array_max("longest_words"), F.lit(0))).drop("longest_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated. Rows are told apart by id and text, so rows
    with a null or repeated id each go by their own text."""
    th = F.xxhash64(strings(docs, text_col))
    kind = T.StructType([T.StructField("bad", docs.schema[id_col].dataType), T.StructField("bad_th", T.LongType())])   # nullable, as Arrow gives it back
    placed = docs.select(F.struct(F.col(id_col), th).cast(kind).alias("place"), strings(docs, text_col).alias("text"))
    bad = materialize(verdicts(matches(placed, benchmark, id_col="place", **options), "place")
                      .filter("contaminated").select("place.*").distinct(), "dc-bad")
    if bad.count() <= 500_000:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad"]) & (th == bad["bad_th"]), "left_anti")


def items_digest(item_ids: list[str]) -> str:
    """``items_sha256`` of a list of item ids."""
    return hashlib.sha256(",".join(sorted(set(item_ids))).encode()).hexdigest()
