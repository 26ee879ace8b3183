"""MinHash near-duplicate detection with sequential Bayesian verification.

A document's set holds the distinct runs of ``shingle_words`` words (lower-cased
A-Z, split at ASCII white space); a shorter document has one run, a document
without words the empty set, linked with nothing. Documents are linked at Jaccard
similarity >= ``threshold``; components follow the links.

1. One pass gives each document its set's 128-bit digest (the class: documents
   with equal sets), size and MinHash signature; classes keep one signature.
2. Signatures are cut into bands. A band value that several classes share is a
   bucket. With 48 bands of 6 rows a pair at 0.8 is missed with probability
   (1 - 0.8^6)^48 < 5e-7.
3. First star round: every member of a bucket is compared with the bucket's first
   member. Copies of one text so cost one comparison each, not one per pair.
   Buckets whose members are in one component by now are closed: further links
   within it change nothing.
4. In open buckets, a shingle that one open member alone has is in no intersection. A
   member whose other shingles are too few for the threshold, against any size of
   partner, is out; so is a pair in which one side's are too few for the two sizes.
   A second star round compares with the member that has the smallest share of
   such shingles of its own, the one nearest to what the copies have in common.
5. What the stars leave open: members in different components of one bucket. Buckets
   are cut into blocks of ``BLOCK`` members and each two blocks meet in one task, which
   compares signatures there, so pairs are not rows; a pair that shares several
   buckets is looked at in the first. So each candidate pair is either
   compared, ruled out by counts or already connected; only step 6 can lose a link.
6. A comparison reads the signatures batch by batch and drops the pair when the
   posterior probability of similarity >= threshold (uniform prior, matches so far)
   is below ``miss``; survivors are verified on the full sets, from the texts. A pair at the
   threshold is lost with probability ``miss`` per look at most, and one has a look per
   ``BATCH`` values (nine), so below 9 * miss in all; more similar ones far less often.
7. Components by least-label propagation over the verified links.

The 128-bit digest stands for its set: sets are taken as equal if their digests are.

Null ids: such rows take part; a component's id is its smallest non-null doc_id,
null if it has none. Repeated rows are copies of one document and have the same
result. Extra columns are ignored, whatever their names. An empty table gives an
empty result; a very long text is taken whole.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, giving_back, input_partitions, materialize, strings
from .hashing import U, WordHash, mix

BANDS, ROWS = 48, 6
BATCH = 32                  # signature values compared between two looks at the posterior
MISS = 1e-4
BLOCK = 1_024                # members of a bucket that are compared in one task with as many others
SEED = 20_240_607
BROADCAST_IDS = 500_000     # ids in a broadcast filter; beyond it a shuffle join


def shingle_set(text: str | None, hashes: WordHash, k: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct k-word runs."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        run = np.full(n, U(len(words) if len(words) < k else k))
        for i in range(min(k, len(h))):
            run = mix(run * U(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(run)


def permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 32, size, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, size, np.uint32)


def signature(prints: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """16 bits of each permutation's least value (the least value is mixed before it is cut)."""
    low, high = (prints & U(0xFFFFFFFF)).astype(np.uint32), (prints >> U(32)).astype(np.uint32)
    least = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(prints), 256):
            a, b = low[at:at + 256], high[at:at + 256]
            x = a[:, None] * mult + add
            x ^= x >> np.uint32(15)
            x = x * np.uint32(0x2C1B3C6D) ^ b[:, None]
            np.minimum(least, x.min(axis=0), out=least)
        least = mix(least.astype(np.uint64))
    return (least & U(0xFFFF)).astype(np.uint16)


def set_digest(prints: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        a = mix(prints + U(1)).sum(dtype=np.uint64)
        b = mix(prints ^ U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


def least_matches(threshold: float, size: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair goes on). With a uniform prior
    P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _fingerprint(shingle_words: int, size: int):
    def run(batches):
        hashes, (mult, add) = WordHash(), permutations(size)
        for batch in batches:
            cls, n, sig = [], [], []
            for text in batch.column(1):
                prints = shingle_set(text.as_py(), hashes, shingle_words)
                cls.append(set_digest(prints) if len(prints) else None)
                n.append(len(prints))
                sig.append(signature(prints, mult, add).tobytes() if len(prints) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()),
                                              pa.array(sig, pa.binary())], names=[batch.schema.names[0], "cls", "n_shingles", "sig"])
    return giving_back(run)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per signature and band."""
    bands = sig.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, r:bands * rows:rows].astype(np.uint64) + U(1))
    return key.view(np.int64)


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bands(rows: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key = band_keys(signatures(batch.column("sig")), rows)
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * key.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.ListArray.from_arrays(pa.array(at), pa.array(key.reshape(-1)))], names=["cls", "keys"])
    return giving_back(run)


def alike(a: np.ndarray, b: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of a and b (signatures) that no look at the posterior drops."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in looks:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _prune(looks: list[tuple[int, int]]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive = alike(signatures(batch.column("sig_a")), signatures(batch.column("sig_b")), looks)
                yield batch.select(["a", "b"]).take(pa.array(alive))
    return giving_back(run)


def _compare_blocks(looks: list[tuple[int, int]], rows: int, num: int, den: int):
    """Members of two blocks of a bucket to the pairs that go on to verification."""
    def run(key, table):
        bucket, one, two = (k.as_py() for k in key)
        blk, n, common = (table[c].to_numpy() for c in ("blk", "n_shingles", "common"))
        comp = np.unique(np.array(table["comp"].to_pylist(), object), return_inverse=True)[1]
        sig, cls = signatures(table["sig"]), np.array(table["cls"].to_pylist(), object)
        keys, out = band_keys(sig, rows), [(np.zeros(0, object), np.zeros(0, object))]
        left, right = np.flatnonzero(blk == one), np.flatnonzero(blk == two)
        for at in range(0, len(left), 64):
            i, j = (x.reshape(-1) for x in np.meshgrid(left[at:at + 64], right, indexing="ij"))
            need = num * (n[i] + n[j])
            keep = (comp[i] != comp[j]) & ((num + den) * np.minimum(common[i], common[j]) >= need)
            if one == two:
                keep &= i < j
            i, j = i[keep], j[keep]
            keep = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == bucket
            i, j = i[keep], j[keep]
            alive = alike(sig[i], sig[j], looks)
            out.append((cls[i[alive]], cls[j[alive]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"p": pa.array(a.tolist(), pa.binary()), "q": pa.array(b.tolist(), pa.binary())})
    return run


def _prints(shingle_words: int):
    """(cls, ztext) to (c1, c2, prints): the class as two numbers and its fingerprints."""
    def run(batches):
        hashes, unzip = WordHash(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = [shingle_set(unzip(t).decode(), hashes, shingle_words) for t in batch.column("ztext").to_pylist()]
            ids = np.frombuffer(b"".join(batch.column("cls").to_pylist()), "<i8").reshape(-1, 2)
            upto = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.ListArray.from_arrays(pa.array(upto), pa.array(flat.view(np.int64)))],
                                             names=["c1", "c2", "prints"])
    return giving_back(run)


def _halves(batches):
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column("cls").to_pylist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=[*batch.schema.names, "c1", "c2"])


def _verify(threshold: Fraction, shingle_words: int):
    def run(batches):
        hashes, packed, last = WordHash(), None, None
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ztext_a"), batch.column("ztext_b"))):
                x = x.as_py()
                if x != packed:
                    packed, last = x, shingle_set(unzip(x).decode(), hashes, shingle_words)
                other = shingle_set(unzip(y.as_py()).decode(), hashes, shingle_words)
                same = len(np.intersect1d(last, other, assume_unique=True))
                if threshold.denominator * same >= threshold.numerator * (len(last) + len(other) - same):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return giving_back(run)


def _texts(shingle_words: int):
    def run(batches):
        hashes, zip_ = WordHash(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            cls, out = [], []
            for text in batch.column(0):
                text = text.as_py()
                prints = shingle_set(text, hashes, shingle_words)
                cls.append(set_digest(prints) if len(prints) else None)
                out.append(zip_((text or "").encode()))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(out, pa.binary())], names=["cls", "ztext"])
    return giving_back(run)


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for the vertices of links (a, b): the smallest vertex reachable."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "cls"), "cc")
    while True:
        near = (both.join(labels.withColumnRenamed("cls", "v"), "v").select(F.col("u").alias("cls"), "comp")
                .union(labels.select("cls", "comp")).groupBy("cls").agg(F.min("comp").alias("step")))
        jump = labels.select(F.col("cls").alias("step"), F.col("comp").alias("far"))
        new = (near.join(jump, "step").join(labels.withColumnRenamed("comp", "was"), "cls")
               .select("cls", F.least("step", "far").alias("comp"), "was"))
        new = materialize(new, "cc")
        if not new.filter("comp <> was").limit(1).count():
            return new.select("cls", "comp")
        labels = new.select("cls", "comp")


class NearDuplicates:
    """One run over a table; ``result()`` has a row per document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.8",
                 shingle_words: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = MISS):
        self.id_col, self.k, self.rows, self.threshold = id_col, shingle_words, rows, Fraction(threshold)
        self.looks = least_matches(float(self.threshold), bands * rows, BATCH, miss)
        self.docs = docs.select(F.col(id_col), strings(docs, text_col).alias("text"))
        schema = T.StructType([docs.schema[id_col], T.StructField("cls", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())])
        self.parts = input_partitions(self.docs)
        marked = materialize(self.docs.mapInArrow(_fingerprint(shingle_words, bands * rows), schema), "nd-marked")
        self.marked = marked.drop("sig")
        self.classes = materialize(marked.filter("cls is not null").groupBy("cls").agg(
            F.min(id_col).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "nd-classes")

    def buckets(self) -> DataFrame:
        """(key, cls) of the band values that several classes share."""
        keyed = (self.classes.select("cls", "sig").mapInArrow(_bands(self.rows), "cls binary, keys array<bigint>")
                 .select("cls", F.explode("keys").alias("key")))
        shared = keyed.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("key")
        return materialize(keyed.join(shared, "key", "left_semi"), "nd-buckets")

    def members(self, buckets: DataFrame) -> DataFrame:
        """(cls, n_shingles, sig, ztext) of the classes in the buckets."""
        wanted = materialize(self.classes.join(buckets.select("cls").distinct(), "cls", "left_semi"), "nd-wanted")
        reps = wanted.select("rep").distinct()
        if wanted.count() <= BROADCAST_IDS:
            reps = F.broadcast(reps)
        found = self.docs.join(reps, self.docs[self.id_col].eqNullSafe(reps["rep"]), "left_semi")
        texts = found.select("text").mapInArrow(_texts(self.k), "cls binary, ztext binary").filter("cls is not null")
        texts = texts.groupBy("cls").agg(F.first("ztext").alias("ztext"))
        return materialize(wanted.drop("rep").join(texts, "cls"), "nd-members")

    def verified(self, members: DataFrame, pairs: DataFrame, pruned: bool = False) -> DataFrame:
        """The pairs (a, b) whose sets are as similar as the threshold asks."""
        side = lambda column, name: members.select(F.col("cls").alias(name), F.col(column).alias(f"{column}_{name}"))
        pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        if not pruned:
            pairs = pairs.join(side("sig", "a"), "a").join(side("sig", "b"), "b").mapInArrow(_prune(self.looks), "a binary, b binary")
            pairs = materialize(pairs, "nd-survivors")
        return materialize(pairs.join(side("ztext", "b"), "b").join(side("ztext", "a"), "a")
                           .mapInArrow(_verify(self.threshold, self.k), "a binary, b binary"), "nd-links")

    def open_members(self, buckets: DataFrame, comp: DataFrame) -> DataFrame:
        """The rows of buckets whose members are in several components."""
        rows = buckets.drop("comp").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        return materialize(rows.join(several, "key", "left_semi"), "nd-open")

    def counted(self, members: DataFrame, open_: DataFrame) -> DataFrame:
        """(cls, n_shingles, sig, common) of the open members that can still have a link;
        ``common``: shingles that another open member has."""
        held = materialize(members.join(open_.select("cls").distinct(), "cls", "left_semi"), "nd-held")
        alone = (held.select("cls", "ztext").mapInArrow(_prints(self.k), "c1 bigint, c2 bigint, prints array<bigint>")
                 .select("c1", "c2", F.explode("prints").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("c1").alias("c1"), F.min("c2").alias("c2"))
                 .filter("n = 1").groupBy("c1", "c2").agg(F.count("*").alias("own")))
        halves = held.select("cls", "n_shingles", "sig").mapInArrow(_halves, "cls binary, n_shingles bigint, sig binary, c1 bigint, c2 bigint")
        num, den = self.threshold.numerator, self.threshold.denominator
        return materialize(halves.join(alone, ["c1", "c2"], "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0)))
                           .filter(den * F.col("common") >= num * F.col("n_shingles")).select("cls", "n_shingles", "sig", "common"), "nd-counted")

    def class_components(self) -> DataFrame:
        buckets = self.buckets()
        members = self.members(buckets)
        lead = buckets.groupBy("key").agg(F.min("cls").alias("p"))
        links = self.verified(members, buckets.join(lead, "key").filter("p <> cls").select("p", F.col("cls").alias("q")))
        comp = components(links)
        open_ = self.open_members(buckets, comp)
        if open_.isEmpty():
            return comp

        num, den = self.threshold.numerator, self.threshold.denominator
        counted = self.counted(members, open_)
        open_ = self.open_members(open_.join(counted.select("cls"), "cls", "left_semi"), comp)
        facts = open_.join(counted.select("cls", "n_shingles", "common"), "cls")
        lead = facts.groupBy("key").agg(F.min_by(F.struct("cls", "comp", "n_shingles", "common"), F.struct(-F.col("common") / F.col("n_shingles"), "cls")).alias("lead"))
        pairs = (facts.join(lead, "key").filter("lead.comp <> comp")
                 .filter((num + den) * F.least("common", "lead.common") >= num * (F.col("n_shingles") + F.col("lead.n_shingles"))))
        new = self.verified(members, pairs.select(F.col("lead.cls").alias("p"), F.col("cls").alias("q")))
        if not new.isEmpty():
            links = links.union(new)
            comp = components(links)
            open_ = self.open_members(open_, comp)
        if open_.isEmpty():
            return comp

        sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = (open_.join(counted, "cls").join(sizes, "key").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        pairs = (dealt.select("key", F.least("blk", "other").alias("one"), F.greatest("blk", "other").alias("two"), "blk", "cls", "comp", "n_shingles", "common", "sig")
                 .groupBy("key", "one", "two").applyInArrow(_compare_blocks(self.looks, self.rows, num, den), "p binary, q binary"))
        new = self.verified(members, pairs, pruned=True)
        return comp if new.isEmpty() else components(links.union(new))

    def result(self) -> DataFrame:
        """(id, n_shingles, component_id, kept)."""
        comp = self.class_components()
        classes = (self.classes.select("cls", "rep").join(comp, "cls", "left")
                   .select("cls", "rep", F.coalesce("comp", "cls").alias("comp")))
        least = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
        self.named = named = materialize(classes.join(least, "comp").select("cls", "component_id"), "nd-named")
        ident = F.col(self.id_col)
        out = (self.marked.filter("cls is not null").join(named, "cls").select(ident, "n_shingles", "component_id")
               .union(self.marked.filter("cls is null").select(ident, "n_shingles", ident.alias("component_id"))))
        return out.withColumn("kept", ident.eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).result()


def _class_of(shingle_words: int, text_at: int, name: str):
    """The rows with the class of their text."""
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            sets = (shingle_set(t.as_py(), hashes, shingle_words) for t in batch.column(text_at))
            cls = [set_digest(p) if len(p) else None for p in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.binary())], names=[*batch.schema.names, name])
    return giving_back(run)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that another document of their group stands for. Rows with
    an id are told apart by it, so rows repeated under one id go or stay together. A row
    without one goes if its group has a document with an id; if none has, nothing names one of
    them and all stay."""
    run = NearDuplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = materialize(run.result(), "nd-result")
    name = free_name(docs, "gone")
    gone = materialize(rows.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(name)).distinct(), "nd-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    stay = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    if rows.filter(~F.col("kept") & F.col(id_col).isNull()).isEmpty():
        return stay
    # the few rows without an id: by the class of their text
    nameless = docs.filter(F.col(id_col).isNull()).withColumn(text_col, strings(docs, text_col))
    cls = free_name(docs, "cls")
    marked = nameless.mapInArrow(_class_of(run.k, nameless.columns.index(text_col), cls), T.StructType([*nameless.schema.fields, T.StructField(cls, T.BinaryType())]))
    stood_for = run.named.filter(F.col("component_id").isNotNull()).select(F.col("cls").alias(cls))
    return stay.filter(F.col(id_col).isNotNull()).union(marked.join(stood_for, cls, "left_anti").select(*docs.columns))
