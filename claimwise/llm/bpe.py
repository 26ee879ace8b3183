"""Byte-level BPE encoding and decoding.

Encoding deals the distinct pre-tokens over the cluster (see ``words``), encodes
each once by the rank file and reassembles the ids by position. Decoding joins
ids to the token-byte table: that table has as many rows as the rank file, which
is counted before it is broadcast.

Null and empty texts encode to no ids and decode to no bytes. Repeated rows give
repeated results; other columns of the input are neither read nor returned, whatever their
names. A very long text is split whole, its words listed a part at a time. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, kept_in_worker
from .words import CHUNK_CHARS, per_document, ragged

MAX_VOCABULARY = 4_000_000   # tokens of a rank file that is broadcast


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; a rank file of up to {MAX_VOCABULARY} is broadcast")
    return ranks


def _per_text(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, chunk_chars: int, partitions: int | None,
              finish, value_type: T.DataType, arrow_type: pa.DataType) -> DataFrame:
    """(id, value): ``finish`` makes an array of values from the list array of the ids of a chunk's texts."""
    shared = docs.sparkSession.sparkContext.broadcast(list(ranks.items()))
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def encoder():
        import tiktoken
        return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=dict(shared.value), special_tokens={})

    def value_of(words: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.uint32) for x in kept_in_worker("byte bpe", key, encoder).encode_ordinary_batch(words, num_threads=1)]

    def reduce(sizes, seq, lens, flat):
        starts = np.cumsum(lens) - lens
        ids = ragged(flat, starts[seq], lens[seq]).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(lens[seq])])[np.concatenate([[0], np.cumsum(sizes)])]
        return finish(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())))

    return per_document(docs, id_col, text_col, pattern, value_of, reduce, value_type, arrow_type, chunk_chars=chunk_chars, partitions=partitions)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, partitions: int | None = None) -> DataFrame:
    """(id, ids array<int>): every text's ids, each match of ``pattern`` encoded by itself."""
    return _per_text(docs, ranks, pattern, id_col, text_col, chunk_chars, partitions, lambda ids: ids,
                     T.ArrayType(T.IntegerType()), pa.list_(pa.int32())).withColumnRenamed("value", "ids")


def encode_with_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
                        chunk_chars: int = CHUNK_CHARS, partitions: int | None = None) -> DataFrame:
    """``digests`` of ``encode``, made where the ids come together, so that they need not travel on."""
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks))
    fields = [*_DIGESTS, ("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] if keep_ids else _DIGESTS
    names = [name for name, _, _ in fields]

    def finish(ids: pa.ListArray) -> pa.Array:
        parts = [pa.StructArray.from_arrays([*_digest_columns(part, shared.value), part][:len(names)], names)
                 for part in (batch.column(0) for batch in _slices([pa.RecordBatch.from_arrays([ids], ["ids"])], "ids"))]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    arrow = pa.struct([(name, kind) for name, _, kind in fields])
    out = _per_text(docs, ranks, pattern, id_col, text_col, chunk_chars, partitions, finish, T.StructType([T.StructField(n, t) for n, t, _ in fields]), arrow)
    return out.select(id_col, *[F.col("value")[n].alias(n) for n in names])


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: starts, lengths and all bytes; -1 for ids without a token."""
    size = max(ranks.values(), default=-1) + 1
    by_id = [None] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    lens = np.array([-1 if t is None else len(t) for t in by_id], np.int64)
    used = np.maximum(lens, 0)
    return np.cumsum(used) - used, lens, np.frombuffer(b"".join(t or b"" for t in by_id), np.uint8)


def _joined(column: pa.Array, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, where each row's begin, their bytes, and where each row's begin; ids join the table by position."""
    starts, lens, flat = table
    ids = column.flatten()
    if ids.null_count:
        raise ValueError("a list holds a null id")
    ids = ids.to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lens) or lens[ids].min() < 0):
        raise ValueError("an id has no token")
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    body = ragged(flat, starts[ids], lens[ids]) if len(ids) else flat[:0]
    return ids, rows, body, np.concatenate([[0], np.cumsum(lens[ids])])[rows]


def _slices(batches, ids_col: str):
    """The batches in slices of a few hundred thousand ids, or of one row."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(pc.fill_null(batch.column(ids_col).value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + 300_000, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with ``out_col`` binary: the bytes of their ids in order. Null ids give
    no bytes; an id outside the table, or a null within a list, is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches):
        for batch in _slices(batches, ids_col):
            _, _, body, at = _joined(batch.column(ids_col), shared.value)
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out_col, T.BinaryType())]))


_DIGESTS = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]


def _digest_columns(column: pa.Array, table) -> list[pa.Array]:
    """Number of ids, digest of the ids (little-endian, 32 bits) and of the decoded bytes, per row."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids, rows, body, at = _joined(column, table)
    raw = ids.astype("<u4")
    return [pa.array(np.diff(rows), pa.int64()), pa.array([sha(raw[a:b].tobytes()) for a, b in zip(rows, rows[1:])], pa.string()),
            pa.array([sha(body[a:b].tobytes()) for a, b in zip(at, at[1:])], pa.string())]


def digests(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): decoded as ``decode`` does, with digests of
    the ids (little-endian, 32 bits) and the bytes in place of the bytes."""
    source = tokens.select(id_col, ids_col)
    shared = tokens.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches):
        for part in _slices(batches, ids_col):
            yield pa.RecordBatch.from_arrays([part.column(0), *_digest_columns(part.column(1), shared.value)], names=[id_col, *[n for n, _, _ in _DIGESTS]])

    return source.mapInArrow(giving_back(run), T.StructType([source.schema[id_col], *[T.StructField(n, t) for n, t, _ in _DIGESTS]]))
