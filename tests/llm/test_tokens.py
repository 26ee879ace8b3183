"""op7 and op10: the library's ids, the round trip, and counts by direct search."""
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from claimwise.llm import bpe, token_counts, words
from claimwise.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN
TEXTS = [(1, None), (2, ""), (3, "Hello  world's\n\n  end "), (4, "été 12³ ½ 漢字　x\x00y"), (5, "<|endoftext|> don't"), (6, "a" * 30_000), (7, " " * 5000 + "x"),
         (3, "Hello  world's\n\n  end "), (None, "no id"), (8, "🙂👍🏽 ok\r\n\t")]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(RANKS)


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 20, "partitions": 5}])
def test_ids_and_round_trip(documents, ranks, options):
    rng = random.Random(1)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(["the", "of", "word", "Zug", "naïve", "42"]) for _ in range(rng.randint(0, 50)))) for i in range(60)]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(rows, {"ids": F.lit("clash"), "value": F.lit(1), "key": F.lit(2)})
    got = bpe.decode(bpe.encode(docs, ranks, PATTERN, **options), ranks).collect()
    assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in got), key=repr) == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)


def test_digests(documents, ranks):
    import hashlib

    import numpy as np
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(bpe.encode(documents([(1, "one two"), (2, None)]), ranks, PATTERN), ranks).collect()}
    ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("one two")
    assert got[1] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"one two").hexdigest())
    assert got[2] == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_digests_where_ids_meet(documents, ranks):
    docs = documents(TEXTS, {"value": F.lit(1), "ids": F.lit(2)})
    tokens = bpe.encode(docs, ranks, PATTERN)
    want = sorted((tuple(r) for r in bpe.digests(tokens, ranks).collect()), key=repr)
    assert sorted((tuple(r) for r in bpe.encode_with_digests(docs, ranks, PATTERN).collect()), key=repr) == want
    kept = bpe.encode_with_digests(docs, ranks, PATTERN, keep_ids=True, chunk_chars=50).collect()
    assert sorted((tuple(r)[:4] for r in kept), key=repr) == want
    assert sorted(((r[0], r["ids"]) for r in kept), key=repr) == sorted((tuple(r) for r in tokens.collect()), key=repr)
    assert bpe.encode_with_digests(documents([]), ranks, PATTERN).collect() == []


def test_rows_of_a_chunk_do_not_follow_the_partitions():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": [" ".join(f"word{i}" for i in range(5_000))]})
    rows = {n: sum(b.num_rows for b in words._pretokenizer(PATTERN, words.BUCKETS, 0, words.CHUNK_CHARS, pa.int64())([batch])) for n in (6, 200, 20_000)}
    assert len(set(rows.values())) == 1 and rows[6] <= words.BUCKETS + 1


def test_known_words_start_anew(monkeypatch):
    import numpy as np
    monkeypatch.setattr(words, "KNOWN_WORDS", 3)
    known = words.Known(lambda new: [np.array([len(w)] * len(w), np.uint32) for w in new])
    for batch in (["a", "bb"], ["ccc", "a", "dddd"], ["bb", "eeeee"], ["a"]):
        known.add(set(batch))
        lens, flat = words.unpack(known.packed(batch))
        assert lens.tolist() == [len(w) for w in batch] and flat.tolist() == [len(w) for w in batch for _ in w]


def test_decode_rejects_unknown_ids(spark, ranks):
    df = spark.createDataFrame([([5, 60_000],)], "ids array<int>")
    with pytest.raises(Exception, match="no token"):
        bpe.decode(df, ranks).collect()


def test_empty_table(documents, ranks):
    assert bpe.encode(documents([]), ranks, PATTERN).collect() == []
    assert token_counts.count_tokens(documents([]), token_counts.zipf_scores(ranks), PATTERN).collect() == []


def direct(word, scores, longest):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores))
    return -best[-1][1]


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 20, "partitions": 5}])
def test_counts_equal_direct_search(documents, ranks, options):
    rows = [r for r in TEXTS if r[0] not in (6, 7)] + [(20 + i, t) for i, t in enumerate(["over overt overture", "the then thenceforth", "preprocessing process"] * 4)]
    scores = token_counts.zipf_scores(ranks)
    longest = max(map(len, scores))
    find = regex.compile(PATTERN).findall
    want = sorted(((i, len(find(t or "")), sum(direct(w.encode(), scores, longest) for w in find(t or ""))) for i, t in rows), key=repr)
    got = token_counts.count_tokens(documents(rows), scores, PATTERN, **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_shared_prefixes_are_scored_once():
    asked = []

    class Scores(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    scores = Scores({bytes([b]): -10 for b in range(256)} | {b"abc": -5})
    assert token_counts.count_words([b"abc", b"abcd", b"abce"], scores, 3) == [1, 2, 2]
    assert len(asked) == 6 + 3 + 3


def test_pack_round_trip():
    import numpy as np
    arrays = [np.array(x, np.int64) for x in ([], [0, 255], [256, 1], [70_000, 3])]
    assert [a.tolist() for a in words.unpack(words.pack(*arrays))] == [a.tolist() for a in arrays]
    assert words.unpack_words(words.pack_words(["é\x00", "", "abc"])) == ["é\x00", "", "abc"]
