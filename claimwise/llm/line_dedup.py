"""Line dedup with a deletion-neighbourhood join.

A line is what stands between newlines; lines are compared by their words (split
at ASCII white space), blank lines are never removed. Two lines are the same when
their words are equal, or, with ``words_per_edit`` words or more, when one word
inserted, deleted or replaced makes them equal. A line goes when an equal or such
a near line stands earlier (smaller doc_id, null last; then smaller line number),
whether or not that one is kept itself.

1. One pass gives each line its 128-bit word hash and four half keys; the earliest
   place of each distinct line is a map-side combined minimum.
2. Two lines within one edit agree in the longer one's first or second half, so
   only lines whose half key another line has can have a near line. The others need
   no neighbourhood: this loses nothing and leaves the copies' lines.
3. Those of ``words_per_edit`` words or more emit all variants with one word
   deleted, as hashes. Lines that differ in word i have the same variant at i: all
   lines with one (variant, i) are within one edit of each other, so the group's
   earliest is everyone's partner and no pairs are made. A line one word longer has
   a variant that equals the shorter line itself; a shorter line, which may be one
   word below ``words_per_edit``, needs no variants for that, and two such lines are
   not near each other. So each candidate is a near line, and one is enough.
4. Each line's earliest partner is verified by edit distance on the words.
5. Each occurrence but the kept first ones goes; documents are rebuilt.

Rows with one doc_id and text are one document: each keeps the same lines. Null
text stays null and empty text empty. Extra columns pass through, whatever their names. An
empty table gives an empty result; a very long text is taken whole, its lines one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, giving_back, materialize, pieces, strings
from .hashing import U, mix

WORDS_PER_EDIT = 10
BROADCAST_ROWS = 500_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)   # odd, hence invertible modulo 2^64


class Rolling:
    """Sums of hash_i * base^i over runs of words, moved to a run's start."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        back = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n + 1, U(base))]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n + 1, U(back))]), dtype=np.uint64)
            self.sums = np.concatenate([[U(0)], np.cumsum(hashes * self.up[:n], dtype=np.uint64)])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The run with the word at ``at`` left out."""
        with np.errstate(over="ignore"):
            return self.run(start, at) + self.run(at + 1, end) * self.up[at - start]


def finish(run: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(run + mix(length.astype(np.uint64) + U(salt)))


#: What ``bytes.split`` splits at, and a random number per byte for word hashes.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
BYTE = np.random.default_rng(20_240_607).integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word in an array of bytes: the sum of its bytes' numbers, each
    times a power of an odd base by its place in the word, and the length, mixed."""
    word = ~BLANK[a]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # place within the word; blanks get a place too, but no number
    place = np.arange(starts[0], len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    word, body = word[starts[0]:], a[starts[0]:]
    lens = np.add.reduceat(word, starts - starts[0], dtype=np.int64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[U(1)], np.full(int(lens.max()) - 1, U(BASES[1]))]), dtype=np.uint64)
        value = np.where(word, BYTE[body] * power[np.minimum(place, len(power) - 1)], U(0))
        sums = np.add.reduceat(value, starts - starts[0], dtype=np.uint64)
    return starts, finish(sums, lens, 17)


def line_hashes(texts: list[str | None]):
    """Lines that are not blank: their text and line number; two 64-bit hashes and word count, with
    the rolling sums and bounds over words."""
    raw = [(t or "").encode() for t in texts]
    a = np.frombuffer(b"\n".join(raw), np.uint8)
    places, flat = word_hashes(a)
    newline = np.flatnonzero(a == 10)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text_at = np.cumsum(sizes + 1) - sizes - 1
    line = np.searchsorted(newline, places)
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    ends = np.append(starts[1:], len(line))
    lens = ends - starts
    owner = np.searchsorted(text_at, places[starts], side="right") - 1
    number = line[starts] - np.searchsorted(newline, text_at[owner])
    rolls = [Rolling(flat, b) for b in BASES]
    h1, h2 = (finish(r.run(starts, ends), lens, k) for k, r in enumerate(rolls))
    return owner, number, h1, h2, lens, starts, ends, rolls


def _lines(words_per_edit: int):
    def run(batches):
        for batch in (p for b in batches for p in pieces(b, "text")):
            owner, number, h1, h2, n, s, e, (roll, _) = line_hashes(batch.column("text").to_pylist())
            if not len(owner):
                continue
            keys = []
            for longer in (n, n + 1):   # as the longer line of a pair, or the shorter
                half = longer // 2
                keys.append(finish(roll.run(s, s + half), longer, 11))
                keys.append(finish(roll.run(np.maximum(e - (longer - half), s), e), longer, 13))
            long_ = n + 1 >= words_per_edit
            take = pa.array(owner, pa.int64())
            signed = [pa.array(x.view(np.int64)) for x in (h1, h2)]
            halves = [pa.array(k.view(np.int64), mask=~long_) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("th").take(take), pa.array(number, pa.int32()), *signed, pa.array(n, pa.int32()), *halves],
                names=["doc", "th", "line", "h1", "h2", "n", "k1", "k2", "k3", "k4"])
    return giving_back(run)


@giving_back
def _chosen_lines(batches):
    """Rows (doc, th, text, lines array<struct<line, h1, h2>>) to one row per listed line with its words."""
    for batch in (p for b in batches for p in pieces(b, "text")):
        h1, h2, words = [], [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist()):
            split = (text or "").encode().split(b"\n")
            for x in lines:
                h1.append(x["h1"])
                h2.append(x["h2"])
                words.append(b" ".join(split[x["line"]].split()).decode())
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(words, pa.string())], names=["h1", "h2", "words"])


def _variants(words_per_edit: int):
    """Rows (h1, h2, f, words) to one row per word left out, of the lines with ``words_per_edit`` words or more."""
    def run(batches):
        for batch in (p for b in batches for p in pieces(b, "words")):
            _, _, _, _, n, s, e, rolls = line_hashes(batch.column("words").to_pylist())       # a line each
            line = np.repeat(np.arange(len(n)), n)
            at = np.flatnonzero(n[line] >= words_per_edit)
            line = line[at]
            v = [finish(r.without(s[line], e[line], at), n[line] - 1, k) for k, r in enumerate(rolls)]
            take = pa.array(line)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(take), batch.column("h2").take(take), batch.column("f").take(take),
                 pa.array(v[0].view(np.int64)), pa.array(v[1].view(np.int64)), pa.array((at - s[line]).astype(np.int32)), pa.array(n[line].astype(np.int32))],
                names=["h1", "h2", "f", "v1", "v2", "i", "n"])
    return giving_back(run)


def within_one_edit(a: list, b: list) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def _verify(words_per_edit: int):
    def run(batches):
        for batch in (p for x in batches for p in pieces(x, "words")):
            keep = []
            for k, (a, b) in enumerate(zip(batch.column("words").to_pylist(), batch.column("words_b").to_pylist())):
                a, b = a.split(" "), b.split(" ")
                if max(len(a), len(b)) >= words_per_edit and within_one_edit(a, b):
                    keep.append(k)
            yield batch.select(["h1", "h2"]).take(pa.array(keep, pa.int64()))
    return giving_back(run)


def _rebuild(schema_names: list[str], text_col: str, gone: str, count: str):
    def run(batches):
        for batch in (p for b in batches for p in pieces(b, text_col)):
            text, removed = [], []
            for t, lines in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist()):
                if lines:
                    out = set(lines)
                    t = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in out)
                text.append(t)
                removed.append(len(lines or ()))
            columns = {n: batch.column(n) for n in schema_names} | {text_col: pa.array(text, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(removed, pa.int64())], names=[*columns, count])
    return giving_back(run)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc, th, gone array<int>): numbers of the lines to remove, per document that has any;
    ``th`` is the text's xxhash64."""
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(strings(docs, text_col)).alias("th"), strings(docs, text_col).alias("text"))
    doc = source.schema["doc"]
    fields = [T.StructField(n, T.LongType()) for n in ("h1", "h2")]
    keys = [T.StructField(f"k{i}", T.LongType()) for i in range(1, 5)]
    occ = materialize(source.mapInArrow(_lines(words_per_edit), T.StructType(
        [doc, T.StructField("th", T.LongType()), T.StructField("line", T.IntegerType()), *fields, T.StructField("n", T.IntegerType()), *keys])), "ld-lines")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "th", "line")
    first = materialize(occ.select("h1", "h2", place.alias("f")).groupBy("h1", "h2").agg(F.min("f").alias("f")), "ld-first")

    # a line stands for itself by h1 alone here: one more with that hash only adds a candidate
    halves = occ.filter("k1 is not null").select("h1", F.explode(F.array("k1", "k2", "k3", "k4")).alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    chosen = halves.join(shared, "key", "left_semi").select("h1").distinct()
    listed = materialize(first.join(chosen, "h1", "left_semi").select("h1", "h2", "f"), "ld-chosen")
    by_doc = listed.groupBy(F.col("f.doc").alias("d"), F.col("f.th").alias("t")).agg(F.collect_list(F.struct(F.col("f.line").alias("line"), "h1", "h2")).alias("lines"))
    small = listed.count() <= BROADCAST_ROWS
    on = source["doc"].eqNullSafe(F.col("d")) & (source["th"] == F.col("t"))
    words = (source.join(F.broadcast(by_doc) if small else by_doc, on).select("text", "lines")
             .mapInArrow(_chosen_lines, "h1 bigint, h2 bigint, words string").groupBy("h1", "h2").agg(F.min("words").alias("words")))
    lines = materialize(listed.join(words, ["h1", "h2"]), "ld-words")

    variants = materialize(lines.mapInArrow(_variants(words_per_edit), T.StructType(
        [*fields, lines.schema["f"], *[T.StructField(n, T.LongType()) for n in ("v1", "v2")], T.StructField("i", T.IntegerType()), T.StructField("n", T.IntegerType())])), "ld-variants")
    key = ["v1", "v2", "i", "n"]
    groups = (variants.groupBy(key).agg(F.min(F.struct("f", "h1", "h2")).alias("p"), F.max(F.struct("f", "h1", "h2")).alias("q"))
              .filter("p <> q").drop("q"))
    replaced = variants.join(groups, key).select("h1", "h2", "f", "p")
    shorter = lines.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.struct("f", "h1", "h2").alias("p"))
    longer = variants.join(shorter, ["v1", "v2"]).select("h1", "h2", "f", "p")
    back = longer.select(F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), F.col("p.f").alias("f"), F.struct("f", "h1", "h2").alias("p"))
    partner = (replaced.union(longer).union(back).filter("p.f < f").groupBy("h1", "h2").agg(F.min("p").alias("p"))
               .select("h1", "h2", F.col("p.h1").alias("b1"), F.col("p.h2").alias("b2")))
    near = (partner.join(lines.select("h1", "h2", "words"), ["h1", "h2"])
            .join(lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("words_b")), ["b1", "b2"])
            .mapInArrow(_verify(words_per_edit), "h1 bigint, h2 bigint"))
    kept = first.join(materialize(near, "ld-near"), ["h1", "h2"], "left_anti").select("h1", "h2", "f")
    gone = (occ.select("h1", "h2", place.alias("f")).join(kept, ["h1", "h2", "f"], "left_anti")
            .groupBy(F.col("f.doc").alias("doc"), F.col("f.th").alias("th")).agg(F.collect_set("f.line").alias("gone")))
    return materialize(gone, "ld-gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT,
                count_col: str = "n_removed") -> DataFrame:
    """The documents with their repeated lines taken out, and the number of lines removed;
    a column of the input named like that number gives way to it."""
    gone = removed_lines(docs, id_col, text_col, words_per_edit)
    size = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    docs = docs.drop(count_col)
    doc, th, lines = (free_name(docs, n) for n in ("_doc", "_th", "_gone"))
    gone = gone.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(lines))
    kinds = {f.name: f for f in docs.schema.fields}
    source = docs.withColumn(text_col, strings(docs, text_col))
    on = F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(th))
    joined = source.join(F.broadcast(gone) if size <= 4 * BROADCAST_ROWS else gone, on, "left").drop(doc, th)
    return joined.mapInArrow(_rebuild(list(kinds), text_col, lines, count_col), T.StructType([*source.schema.fields, T.StructField(count_col, T.LongType())]))
