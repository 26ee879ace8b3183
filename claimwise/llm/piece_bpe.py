"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the model's leading space mark, its spaces become marks, and it is cut into
words where no piece can reach across. A task encodes each distinct word it meets once:
the code points of all new words lie in one flat array of symbols, and every round finds
the best rank among the pairs of neighbours of each word by a segmented minimum, merges the
occurrences of that rank from the left, and compacts the array; words without a pair left
leave it. Characters outside the vocabulary become their bytes' pieces at the end.

The rounds give what merging one pair at a time gives, best score first and leftmost of
equals: a round merges a word's further occurrences only up to the first one whose merge
forms a pair that is as good or better, since that pair's turn comes before the rest.

Words are also cut between characters that are neighbours in no piece. Runs of marks are
cut every K where K marks are the longest such piece, if pieces of marks rank behind all
others and a run is consumed from the left in pieces of K (this is tried when the model is
loaded); so a long run of spaces takes no more rounds than a short one.

Everything happens within a row's own task: no shuffle and no state besides the word store,
which is emptied when it reaches ``STORE_WORDS`` or ``STORE_CHARS``. Very long texts are taken
in slices of about ``SLICE_CHARS``, cut between words. Decoding joins ids to the table of the
pieces' bytes. Null and empty texts encode to no ids, and no ids decode to the empty text.
Repeated rows give repeated results; other columns are neither read nor returned, whatever
their names. An empty table gives an empty result.

Models of the kind BPE with byte fallback, without normalisation rules or pieces defined
by the user are supported; another one is refused.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, pieces, strings
from .words import Index, ragged

SPACE = "▁"
STORE_WORDS, STORE_CHARS, SLICE_CHARS = 200_000, 4_000_000, 1_000_000
MAX_PIECES = 4_000_000      # pieces of a model that is broadcast
NEVER = np.iinfo(np.int32).max
_SHIFT = 22                 # a symbol is a piece id, or the number of pieces plus a code point

# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    """The tables that encoding and decoding need."""
    size: int
    chars: np.ndarray       # code points that are pieces, ascending, and their ids
    char_ids: np.ndarray
    slots: np.ndarray       # keys of mergeable symbol pairs by hash, -1 where empty; rank and id of the merged piece
    ranks: np.ndarray
    merged: np.ndarray
    left: np.ndarray        # class of each of ``chars`` as the first and as the second of two neighbours in a piece
    right: np.ndarray
    neighbours: np.ndarray  # by both classes: such a piece exists
    run: int                # marks after which a run is cut; 0: never
    byte_ids: np.ndarray
    surfaces: list          # by id: the bytes it decodes to, before the first mark is dropped
    kinds: np.ndarray
    marked: np.ndarray      # by id: a normal piece that begins with a mark
    prefix: bool            # texts get a leading mark


def load_model(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = np.array([p.type for p in proto.pieces], np.int32)
    spec, trained = proto.normalizer_spec, proto.trainer_spec
    if (trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or (kinds == USER_DEFINED).any() or (kinds == UNUSED).any()
            or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or (kinds == BYTE).sum() != 256):
        raise ValueError("not a BPE model with byte fallback and without normalisation and own pieces")
    if len(kinds) > MAX_PIECES:
        raise ValueError(f"{len(kinds)} pieces; a model of up to {MAX_PIECES} is broadcast")
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
    if any(SPACE in piece.lstrip(SPACE) for piece in normal):
        raise ValueError("a piece holds a space within or behind a word")
    size = len(kinds)
    order = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
    rank = {piece: order[proto.pieces[i].score] for piece, i in normal.items()}
    symbol = lambda x: normal[x] if x in normal else size + ord(x) if len(x) == 1 else None
    found = {}
    for piece, i in normal.items():
        for k in range(1, len(piece)):
            a, b = symbol(piece[:k]), symbol(piece[k:])
            if a is not None and b is not None:
                found[(a << _SHIFT) | b] = rank[piece], i
    slots, place_of = _hashed(np.array(sorted(found), np.int64))
    chars = np.array(sorted({ord(c) for piece in normal for c in piece}), np.uint32)
    place = {int(c): k for k, c in enumerate(chars)}
    firsts = sorted({piece[k] for piece in normal for k in range(len(piece) - 1)})
    seconds = sorted({piece[k] for piece in normal for k in range(1, len(piece))})
    left, right = np.zeros(len(chars) + 1, np.int64), np.zeros(len(chars) + 1, np.int64)   # the last is for all other characters
    for n, c in enumerate(firsts):
        left[place[ord(c)]] = n + 1
    for n, c in enumerate(seconds):
        right[place[ord(c)]] = n + 1
    neighbours = np.zeros((len(firsts) + 1, len(seconds) + 1), bool)
    for piece in normal:
        for x, y in zip(piece, piece[1:]):
            neighbours[left[place[ord(x)]], right[place[ord(y)]]] = True
    byte_ids = np.zeros(256, np.int64)
    surfaces = []
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            surfaces.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            surfaces.append(b"" if p.type == CONTROL else trained.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode())
    marked = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
    ranks, merged = np.full(len(slots), NEVER, np.int32), np.full(len(slots), -1, np.int64)
    for at, key in zip(place_of.tolist(), sorted(found)):
        ranks[at], merged[at] = found[key]
    return Model(size, chars, np.array([symbol(chr(c)) for c in chars], np.int64), slots, ranks, merged, left, right, neighbours, _run_of_marks(normal, rank), byte_ids, surfaces,
                 kinds, marked, bool(spec.add_dummy_prefix))


def _run_of_marks(normal: dict[str, int], rank: dict[str, int]) -> int:
    """The K of the module's text, or 0 if the model does not consume runs that way."""
    marks = {len(p) for p in normal if p.strip(SPACE) == ""}
    longest = max(marks, default=0)
    last = max(rank.values(), default=0)
    if (longest < 2 or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal) or any(rank[SPACE * n] != last for n in marks if n > 1)
            or any(rank[p] == last and p.strip(SPACE) for p in normal if len(p) > 1)):
        return 0
    for n in range(longest, 3 * longest + 1):
        run = [1] * n
        while (at := next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in marks), -1)) >= 0:
            run[at:at + 2] = [run[at] + run[at + 1]]
        if run[0] != longest:
            return 0
    return longest


def _home(keys: np.ndarray, size: int) -> np.ndarray:
    """Where the search for a key begins in a table of ``size`` (a power of two) slots."""
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in a hash table with linear probing, a quarter full at most, and each key's slot."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    slots, place = np.full(size, -1, np.int64), np.zeros(len(keys), np.int64)
    for n, (key, at) in enumerate(zip(keys.tolist(), _home(keys, size).tolist())):
        while slots[at] >= 0:
            at = (at + 1) % size
        slots[at], place[n] = key, at
    return slots, place


def _lookup(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slot of each pair, of an empty one if the two do not merge."""
    key = (a << _SHIFT) | b
    at = _home(key, len(model.slots))
    there = model.slots[at]
    ask = np.flatnonzero((there != key) & (there >= 0))
    while len(ask):
        at[ask] = (at[ask] + 1) & (len(model.slots) - 1)
        there = model.slots[at[ask]]
        ask = ask[(there != key[ask]) & (there >= 0)]
    return at


def _rank(model: Model, a: np.ndarray, b: np.ndarray, together: np.ndarray) -> np.ndarray:
    out = np.full(len(a), NEVER, np.int32)
    out[together] = model.ranks[_lookup(model, a[together], b[together])]
    return out


def merge(model: Model, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their (ascending) segments after all merges."""
    done = []
    rank = np.full(len(sym), NEVER, np.int32)
    rank[:-1] = _rank(model, sym[:-1], sym[1:], seg[:-1] == seg[1:])
    while len(sym):
        starts = np.flatnonzero(np.diff(seg, prepend=-1))
        counts = np.diff(np.append(starts, len(sym)))
        low = np.minimum.reduceat(rank, starts)
        live = low < NEVER
        if not live.all():
            keep = np.repeat(live, counts)
            done.append((sym[~keep], seg[~keep]))
            sym, seg, rank, low, counts = sym[keep], seg[keep], rank[keep], low[live], counts[live]
            if not len(sym):
                break
        bar = np.repeat(low, counts)
        hit = np.flatnonzero(rank == bar)
        # of overlapping occurrences every other one, from the left
        step = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, step, 0))
        hit = hit[(step - run) % 2 == 0]
        new = model.merged[_lookup(model, sym[hit], sym[hit + 1])]
        own, bar = seg[hit], bar[hit]
        before = np.where(np.diff(hit, prepend=-9) == 2, np.roll(new, 1), sym[hit - 1])
        after = np.minimum(hit + 2, len(sym) - 1)
        early = np.minimum(_rank(model, before, new, (hit > 0) & (seg[hit - 1] == own)),
                           _rank(model, new, sym[after], (hit + 2 < len(sym)) & (seg[after] == own))) <= bar
        if early.any():
            passed = np.cumsum(early) - early
            first = np.flatnonzero(np.diff(own, prepend=-1))
            wait = passed > np.repeat(passed[first], np.diff(np.append(first, len(own))))
            hit, new = hit[~wait], new[~wait]
        sym[hit] = new
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, seg, rank = sym[keep], seg[keep], rank[keep]
        at = hit - np.arange(len(hit))
        at = np.concatenate([at, at[at > 0] - 1])
        then = np.minimum(at + 1, len(sym) - 1)
        rank[at] = _rank(model, sym[at], sym[then], (at + 1 < len(sym)) & (seg[at] == seg[then]))
    if not done:
        return sym, seg
    sym, seg = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(seg, kind="stable")
    return sym[order], seg[order]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each (non-empty) word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.zeros(len(points), bool)
    begin[np.cumsum(lens) - lens] = True
    at = np.minimum(np.searchsorted(model.chars, points), len(model.chars) - 1)
    known = model.chars[at] == points
    at = np.where(known, at, len(model.chars))
    sym = np.where(known, model.char_ids[np.minimum(at, len(model.chars) - 1)], model.size + points.astype(np.int64))
    cut = begin.copy()
    cut[1:] |= ~model.neighbours[model.left[at[:-1]], model.right[at[1:]]]
    if model.run:
        mark = points == ord(SPACE)
        place = np.arange(len(points))
        head = np.maximum.accumulate(np.where(mark & (begin | ~np.concatenate([[False], mark[:-1]])), place, 0))
        cut |= mark & ((place - head) % model.run == 0)
    seg = np.cumsum(cut) - 1
    word_of = (np.cumsum(begin) - 1)[cut]
    sym, seg = merge(model, sym, seg)
    # characters that are no piece: the pieces of their bytes
    odd = np.flatnonzero(sym >= model.size)
    sizes = np.ones(len(sym), np.int64)
    raw = [chr(c).encode() for c in (sym[odd] - model.size).tolist()]
    sizes[odd] = list(map(len, raw))
    ids = np.repeat(sym, sizes)
    ids[ids >= model.size] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(word_of[seg], weights=sizes, minlength=len(words)).astype(np.int64)


_WORD, _BETWEEN = re.compile(f"{SPACE}*+[^{SPACE}]+|{SPACE}+"), re.compile(f"[^{SPACE}]{SPACE}")


def _slices(text: str, limit: int):
    """Slices of the text, cut before a mark that follows another character."""
    at = 0
    while len(text) - at > limit and (m := _BETWEEN.search(text, at + limit)):
        yield text[at:m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Store:
    """Ids of the distinct words that a task has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.index, self.chars = Index(), 0
        self.flat, self.starts, self.lens = (np.zeros(0, np.int64) for _ in range(3))

    def _add(self, words: list[str]) -> None:
        ids, lens = encode_words(self.model, words)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new words of all texts go through the rounds together."""
        if len(self.index) > STORE_WORDS or self.chars > STORE_CHARS:
            self.clear()
        count = len(self.index)
        seqs = [self.index.of(_WORD.findall(text)) for text in texts]
        if len(self.index) > count:
            self._add(list(islice(self.index, count, None)))
        return [ragged(self.flat, self.starts[s], self.lens[s]) for s in seqs]

    def encode_long(self, text: str) -> np.ndarray:
        """As ``encode`` of one text, in slices."""
        return np.concatenate([self.encode([s])[0] for s in _slices(text, SLICE_CHARS)])


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every text's ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col), strings(docs, text_col).alias("text"))

    def run(batches):
        model = shared.value
        store = Store(model)
        head = SPACE if model.prefix else ""
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [head + t.replace(" ", SPACE) if t else "" for t in piece.column(1).to_pylist()]
                ids = store.encode(texts) if len(texts) > 1 else [store.encode_long(t) for t in texts]
                upto = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return source.mapInArrow(giving_back(run), T.StructType([source.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _valid(text: bytes) -> bool:
    try:
        text.decode()
        return True
    except UnicodeDecodeError:
        return False


class Decoder:
    """The pieces' bytes by id."""

    def __init__(self, model: Model):
        self.model = model
        self.lens = np.fromiter(map(len, model.surfaces), np.int64, len(model.surfaces))
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(model.surfaces), np.uint8)

    def texts(self, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row of ids; row r has ids[upto[r]:upto[r + 1]]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.model.size):
            raise ValueError("an id has no piece")
        body = ragged(self.flat, self.starts[ids], self.lens[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.lens[ids])])[upto].tolist()
        raw, hidden = self.model.kinds[ids] == BYTE, self.model.kinds[ids] == CONTROL
        out = []
        for r, (a, b) in enumerate(zip(upto.tolist(), upto[1:].tolist())):
            text = body[at[r]:at[r + 1]]
            if raw[a:b].any() and (hidden[a:b].any() or not _valid(text)):
                text = self._repaired(ids[a:b])
            if self.model.prefix:
                shown = next((i for i in range(a, b) if not hidden[i]), None)
                if shown is not None and self.model.marked[ids[shown]]:
                    text = text[1:]
            out.append(text)
        return out

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces that are no UTF-8 have a replacement character for each wrong byte."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.model.kinds[i] == BYTE:
                run += self.model.surfaces[i]
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            out.append(self.model.surfaces[i] if i >= 0 else b"")
        return b"".join(out)


def _rows(batch: pa.RecordBatch, column: int, limit: int = 300_000):
    """Slices of a few hundred thousand ids, or of one row: (slice, ids, where each row's begin)."""
    sizes = pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, side="right")) - 1)
        piece = batch.slice(at, to - at)
        ids = piece.column(column).flatten()
        if ids.null_count:
            raise ValueError("a list holds a null id")
        yield piece, ids.to_numpy(zero_copy_only=False).astype(np.int64), upto[at:to + 1] - upto[at]
        at = to


def decode(tokens: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids. Null ids give the empty text; an id outside
    the model, or a null within a list, is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    source = tokens.select(id_col, ids_col)

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for piece, ids, upto in _rows(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([t.decode() for t in decoder.texts(ids, upto)], pa.string())], names=[id_col, "text"])

    return source.mapInArrow(giving_back(run), T.StructType([source.schema[0], T.StructField("text", T.StringType())]))


def digests(tokens: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): decoded as ``decode`` does, with digests of the
    ids as decimal numbers joined by commas and of the text in UTF-8."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    source = tokens.select(id_col, ids_col)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        decoder = Decoder(shared.value)
        numbers = [b"%d," % i for i in range(shared.value.size)]
        lens = np.fromiter(map(len, numbers), np.int64, len(numbers))
        starts, flat = np.cumsum(lens) - lens, np.frombuffer(b"".join(numbers), np.uint8)
        for batch in batches:
            for piece, ids, upto in _rows(batch, 1):
                texts = decoder.texts(ids, upto)
                body = ragged(flat, starts[ids], lens[ids]).tobytes()
                at = np.concatenate([[0], np.cumsum(lens[ids])])[upto].tolist()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(np.diff(upto), pa.int64()), pa.array([sha(body[a:max(a, b - 1)]) for a, b in zip(at, at[1:])], pa.string()),
                    pa.array(list(map(sha, texts)), pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(giving_back(run), T.StructType([
        source.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
