"""Global distinct-word shuffle.

Texts are split into pre-tokens with their positions. Within a chunk of whole
texts the pre-tokens are replaced by indices into the chunk's distinct words, so
the position column stays with the chunk (packed) and only the chunk's distinct
words travel. Words are dealt by hash, every distinct word meets in one task and
is valued once, and the values return to their chunks, where the rows are
reassembled in position order.

One exchange carries both kinds of rows (key ``c…`` for a chunk's positions, ``b…``
for a word bucket) and is read twice, so texts are split once; a hot word costs one entry per chunk, whatever its count.
Words are dealt over ``BUCKETS`` buckets at any number of partitions, so that a row holds some
hundred words of a full chunk; the valuing step has that many tasks at most. A valuing task
keeps the values of the words it has met, as flat arrays, up to ``KNOWN_WORDS``; beyond that
it starts anew and values a word again when it meets it.
A chunk is the pair (input partition, ordinal), so the input has to be a
deterministic scan, as a table read is: a recomputed partition then gives the
same chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, input_partitions, strings

CHUNK_CHARS = 4_000_000
BUCKETS = 512
KNOWN_WORDS = 200_000
#: Words of a text that are held as a list, and word rows that are valued, at once.
LISTED_CHARS, VALUED_ROWS = 1_000_000, 250


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of small unsigned integers as one compressed block; bytes of one
    significance are stored together."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        planes = np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :width]
        parts += [np.array([len(a), width], "<u4").tobytes(), planes.T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
    for _ in range(n):
        size, width = (int(x) for x in np.frombuffer(raw, "<u4", 2, at))
        at += 8
        planes = np.zeros((size, 4), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(planes.view("<u4").reshape(-1))
        at += size * width
    return out


def pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    body = pack(np.fromiter(map(len, raw), np.int64, len(raw)))
    return np.uint32(len(body)).tobytes() + body + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def unpack_words(data: bytes) -> list[str]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lens = unpack(data[4:4 + n])[0]
    raw = zstandard.ZstdDecompressor().decompress(data[4 + n:])
    ends = np.cumsum(lens.astype(np.int64)).tolist()
    return [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s+n]`` over the given starts and lengths."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class Index(dict):
    """Number of each word, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32)


def _indices(pattern: "regex.Pattern", text: str, index: Index) -> np.ndarray:
    if len(text) <= LISTED_CHARS:
        return index.of(pattern.findall(text))
    return index.of(m.group() for m in pattern.finditer(text))


def _pretokenizer(pattern: str, buckets: int, bucket_chars: int, chunk_chars: int, id_type: pa.DataType):
    def run(batches):
        find = regex.compile(pattern)
        task = TaskContext.get()
        part, ordinal = task.partitionId() if task else 0, 0
        index = Index()
        ids, seqs, chars = [], [], 0

        def flush():
            nonlocal index, ids, seqs, chars, ordinal
            key = f"c{part}_{ordinal}"
            words = list(index)
            bucket = [xxhash.xxh32_intdigest((w[:bucket_chars] if bucket_chars else w).encode()) % buckets for w in words]
            order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
            seq = place[np.concatenate(seqs)] if int(lens.sum()) else np.zeros(0, np.int64)
            rows = {"key": [key], "chunk": [key], "bucket": [-1], "data": [pack(lens, seq)], "ids": [ids]}
            at = 0
            while at < len(order):
                b, to = bucket[order[at]], at
                while to < len(order) and bucket[order[to]] == b:
                    to += 1
                rows["key"].append(f"b{b}")
                rows["chunk"].append(key)
                rows["bucket"].append(b)
                rows["data"].append(pack_words([words[i] for i in order[at:to]]))
                rows["ids"].append(None)
                at = to
            index, ids, seqs, chars, ordinal = Index(), [], [], 0, ordinal + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["key"], pa.string()), pa.array(rows["chunk"], pa.string()), pa.array(rows["bucket"], pa.int32()),
                 pa.array(rows["data"], pa.binary()), pa.array(rows["ids"], pa.list_(id_type))],
                names=["key", "chunk", "bucket", "data", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                seqs.append(_indices(find, text, index))
                ids.append(doc)
                chars += len(text)
                if chars >= chunk_chars:
                    yield flush()
        if ids:
            yield flush()

    return giving_back(run)


class Known:
    """Values of the words met so far: flat arrays, and the number of each word."""

    def __init__(self, value_of: Callable[[list[str]], list[np.ndarray]]):
        self.value_of = value_of
        self.clear()

    def clear(self):
        self.index, self.lens, self.flat, self.starts = Index(), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, words: set[str]) -> None:
        if len(self.index) > KNOWN_WORDS:
            self.clear()
        new = sorted(w for w in words if w not in self.index)
        if new:
            values = self.value_of(new)
            self.index.of(new)
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, values), np.int64, len(values))])
            self.flat = np.concatenate([self.flat, *values]).astype(np.uint32, copy=False)
            self.starts = np.cumsum(self.lens) - self.lens

    def packed(self, words: list[str]) -> bytes:
        at = self.index.of(words)
        return pack(self.lens[at], ragged(self.flat, self.starts[at], self.lens[at]))


def _valuer(value_of: Callable[[list[str]], list[np.ndarray]]):
    """Word rows in, value rows out; the words of a task are valued when they are first met."""
    def run(batches):
        known = Known(value_of)
        for batch in batches:
            batch = batch.filter(pc.greater_equal(batch.column("bucket"), 0))
            for at in range(0, batch.num_rows, VALUED_ROWS):
                part = batch.slice(at, VALUED_ROWS)
                rows = [unpack_words(x) for x in part.column("data").to_pylist()]
                known.add(set().union(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("chunk"), part.column("bucket"), pa.array([known.packed(words) for words in rows], pa.binary())], names=["key", "bucket", "data"])

    return giving_back(run)


def _assembler(reduce, id_type: pa.DataType, value_type: pa.DataType, id_name: str):
    def run(chunk: pa.Table, values: pa.Table) -> pa.Table:
        out_ids, outs = [], []
        if chunk.num_rows:
            blocks = [unpack(x) for _, x in sorted(zip(values["bucket"].to_pylist(), values["data"].to_pylist()))]
            lens = np.concatenate([b[0] for b in blocks]).astype(np.int64) if blocks else np.zeros(0, np.int64)
            flat = np.concatenate([b[1] for b in blocks]) if blocks else np.zeros(0, np.uint32)
            for doc_ids, data in zip(chunk["ids"], chunk["data"].to_pylist()):
                sizes, seq = unpack(data)
                out_ids.append(doc_ids.values.cast(id_type))
                outs.append(reduce(sizes.astype(np.int64), seq.astype(np.int64), lens, flat))
        return pa.table({id_name: pa.chunked_array(out_ids, id_type), "value": pa.chunked_array(outs, value_type)})

    return run


def per_document(docs: DataFrame, id_col: str, text_col: str, pattern: str, value_of, reduce, value_type: T.DataType,
                 arrow_type: pa.DataType, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = 0,
                 partitions: int | None = None) -> DataFrame:
    """Rows (id, ``value``), one per input row.

    ``value_of``: sorted distinct pre-tokens -> one unsigned array each.
    ``reduce``: (pre-tokens per text, word index per position, values per word,
    flat values) -> an Arrow array with one element per text.
    ``bucket_chars``: deal words by their first characters (0: by all), so that
    words with a common prefix meet.
    """
    id_field = docs.schema[id_col]
    id_type = T.StructType([id_field])
    arrow_id = _arrow_type(id_field.dataType)
    n = partitions or input_partitions(docs)
    source = docs.select(F.col(id_col), strings(docs, text_col).alias("text"))
    pre = source.mapInArrow(
        _pretokenizer(pattern, BUCKETS, bucket_chars, chunk_chars, arrow_id),
        T.StructType([T.StructField("key", T.StringType()), T.StructField("chunk", T.StringType()),
                      T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType()),
                      T.StructField("ids", T.ArrayType(id_field.dataType))])).repartition(n, "key")
    values = pre.mapInArrow(_valuer(value_of), "key string, bucket int, data binary").repartition(n, "key")
    schema = T.StructType([id_type[0], T.StructField("value", value_type)])
    # a condition on a row number stays above the exchange, which both sides then share
    positions = pre.filter(F.when(F.monotonically_increasing_id() >= 0, F.col("bucket") < 0))
    return (positions.groupBy("key").cogroup(values.groupBy("key"))
            .applyInArrow(_assembler(reduce, arrow_id, arrow_type, id_col), schema))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
