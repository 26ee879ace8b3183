"""op11 against the library, in both directions."""
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimwise.llm import piece_bpe as pb
from claimwise.llm.queries import PIECES

PARTS = ["a", "b", "e", "t", "h", "the", " ", "  ", "    ", "\n", "\t", "é", "漢", "\U0001f642", "▁", "in", "ing", "1", "12", "A", "S", "er", "re", ".", "==", "--", "aaaa", "\x00",
         "<s>", "<0x0A>", "�"]
TEXTS = [(1, None), (2, ""), (3, "Hello  world's\n\n  end "), (4, "été 12³ ½ 漢字　x\x00y"), (5, "▁literal mark ▁"), (6, "a" * 30_000), (7, " " * 50_000 + "x"),
         (3, "Hello  world's\n\n  end "), (None, "no id"), (8, "\U0001f642\U0001f44d\U0001f3fd ok\r\n\t"), (9, " "), (10, "word " * 70_000), (11, "abcXYZ019" * 9_000)]


@pytest.fixture(scope="module")
def model():
    return pb.load_model(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def encoded(model, texts):
    return [x.tolist() for x in pb.Store(model).encode(["▁" + t.replace(" ", "▁") if t else "" for t in texts])]


def decoded(model, rows):
    upto = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return [t.decode() for t in pb.Decoder(model).texts(np.array([i for r in rows for i in r], np.int64), upto)]


def test_ids_and_round_trip(documents, model, library, monkeypatch):
    monkeypatch.setattr(pb, "SLICE_CHARS", 10_000)
    monkeypatch.setattr(pb, "STORE_WORDS", 50)
    rng = random.Random(1)
    rows = TEXTS + [(100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs = documents(rows, {"ids": F.lit("clash"), "n_tokens": F.lit(1), "decoded_sha256": F.lit(2)})
    tokens = pb.encode(docs, model)
    want = [(i, library.encode(t or "")) for i, t in rows]
    assert sorted(((r[0], list(r[1])) for r in tokens.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in pb.decode(tokens, model).collect()), key=repr) == sorted(((i, library.decode(x)) for i, x in want), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((tuple(r) for r in pb.digests(tokens, model).collect()), key=repr) == sorted(
        ((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in want), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=20), max_size=8))
def test_any_text(model, library, texts):
    got = encoded(model, texts)
    assert got == library.encode(texts)
    assert decoded(model, got) == library.decode(got) if got else True


def test_runs(model, library):
    texts = [" " * n + w for n in range(60) for w in ("", "foo", "x ")] + [c * n for c in ("a", "=", "- ", "ab") for n in range(90)]
    assert encoded(model, texts) == library.encode(texts)


def test_any_ids(model, library):
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), 3 + rng.randrange(256), 259, 300 + rng.randrange(31_000)]) for _ in range(rng.randint(0, 12))] for _ in range(5_000)]
    assert decoded(model, rows) == [library.decode(r) for r in rows]


def tiny(pieces):
    """A model of the given pieces, best first."""
    from sentencepiece import sentencepiece_model_pb2 as pb2
    proto = pb2.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 2, True
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces = "identity", False
    for name, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)]:
        proto.pieces.add(piece=name, score=0, type=kind)
    for n, piece in enumerate(pieces):
        proto.pieces.add(piece=piece, score=-float(n), type=1)
    return proto.SerializeToString()


@pytest.mark.parametrize("seed", range(6))
def test_merges_that_overtake(tmp_path, seed):
    """In models whose longer pieces rank before their parts, one merge can let another go first."""
    rng = random.Random(seed)
    pieces = list(dict.fromkeys("".join(rng.choice("ab▁") if k == 0 else rng.choice("ab") for k in range(rng.randint(2, 6))) for _ in range(40)))
    rng.shuffle(pieces)
    raw = tiny([*pieces, "a", "b", "▁"])
    path = tmp_path / "tiny.model"
    path.write_bytes(raw)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pb.load_model(str(path))
    texts = ["".join(rng.choice("aabb c") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert encoded(model, texts) == library.encode(texts)


def test_wrong_ids_and_models(spark, model, tmp_path):
    with pytest.raises(Exception, match="no piece"):
        pb.decode(spark.createDataFrame([(1, [5, 60_000])], "doc_id int, ids array<int>"), model).collect()
    with pytest.raises(Exception, match="null id"):
        pb.decode(spark.createDataFrame([(1, [5, None])], "doc_id int, ids array<int>"), model).collect()
    path = tmp_path / "own.model"
    path.write_bytes(tiny(["a ▁b".replace(" ", ""), "a", "b", "▁"]))
    with pytest.raises(ValueError, match="within or behind"):
        pb.load_model(str(path))


def test_empty_table(documents, model):
    tokens = pb.encode(documents([]), model)
    assert tokens.collect() == [] and pb.decode(tokens, model).collect() == [] and pb.digests(tokens, model).collect() == []
