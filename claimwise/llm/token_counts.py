"""Token counts of texts under a unigram vocabulary.

A pre-token's count is the number of pieces in its most probable split. Forward
scores of a prefix depend on the prefix alone, so distinct pre-tokens are taken in
sorted order, which is a walk over their trie: the path from the root to the word before is
kept, and only the nodes below the branching point are scored; a word's count is stored where
it ends. Words are dealt by their first six characters, so words that share these meet in one
task; a task walks the trie of the new words of every few hundred word rows that it reads, so a
shared prefix is scored once per such walk, and a word once per task (see ``words``). The counts
return to the texts as there.

Scores are whole numbers (micro-nats), so equal sums are equal; of splits with the
same score the one with fewer pieces counts. Null and empty texts count 0. Repeated rows have equal
counts; other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import CHUNK_CHARS, per_document


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Unigram log-probabilities from a rank file by Zipf's law, in micro-nats."""
    norm = sum(1 / (r + 1) for r in ranks.values())
    return {t: round(-1e6 * (math.log(r + 1) + math.log(norm))) for t, r in ranks.items()}


def count_words(words: list[bytes], scores: dict[bytes, int], longest: int) -> list[int]:
    """Pieces in the best split of each word. ``words`` are sorted, so that the path
    from the trie's root to the word before is kept and only the nodes below the
    branching point are made and scored."""
    get = scores.get
    best, pieces, before, out = [0], [0], b"", []
    for word in words:
        n, same = len(word), 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        del best[same + 1:], pieces[same + 1:]
        for end in range(same + 1, n + 1):
            top, fewest = None, 0
            for start in range(max(0, end - longest), end):
                if best[start] is None:
                    continue
                s = get(word[start:end])
                if s is None:
                    continue
                s += best[start]
                if top is None or s > top or s == top and pieces[start] + 1 < fewest:
                    top, fewest = s, pieces[start] + 1
            best.append(top)
            pieces.append(fewest)
        if best[n] is None:
            raise ValueError(f"no split of {word!r}: the vocabulary lacks a byte")
        out.append(pieces[n])
        before = word
    return out


def count_tokens(docs: DataFrame, scores: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS, partitions: int | None = None, bucket_chars: int = 6) -> DataFrame:
    """(id, n_pretokens, n_tokens), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast((scores, max(map(len, scores), default=1)))

    def value_of(words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        counts = np.empty((len(raw), 1), np.uint32)
        counts[order, 0] = count_words([raw[i] for i in order], *shared.value)
        return list(counts)

    def reduce(sizes, seq, lens, flat):
        upto = np.concatenate([[0], np.cumsum(flat[seq].astype(np.int64))])
        ends = np.cumsum(sizes)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(upto[ends] - upto[ends - sizes], pa.int64())], ["n_pretokens", "n_tokens"])

    pair = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
    out = per_document(docs, id_col, text_col, pattern, value_of, reduce,
                       T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]),
                       pair, chunk_chars=chunk_chars, partitions=partitions, bucket_chars=bucket_chars)
    return out.select(F.col(id_col), "value.n_pretokens", "value.n_tokens")
