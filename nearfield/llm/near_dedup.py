"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document is the set of its distinct word shingles. Documents with equal sets are one class, compared once. Classes that share
a MinHash band meet in a bucket, with their odd sketches (MinHash samples folded into a bitmap of parities, so that the bits in
which two bitmaps differ tell how many samples differ) but without their texts. Sketches pick pairs worth a look; then the texts of these pairs' classes are fetched, and the full sets confirm them. Each task
gives a spanning forest of its confirmed links, never all pairs: connections are what the result is made of, and a forest has all of
them. Components come from the forests.

Bands: enough that a link at the threshold is missed by all of them with a chance below MISS. Sketches: a pair is left out only if its
sample estimate lies six standard deviations under the threshold.

Scale: one pass over the texts gives 16-byte set keys, bands and 64-byte sketches. Copies of a set are folded before anything is joined. A bucket is
dealt out in blocks of about BLOCK classes and at most about BLOCK_SHINGLES shingles, so no bucket, however large, is gathered; buckets with
the same members are taken once, and a pair is looked at in its first shared band only. First each block is looked at by itself, with about HUBS members of its bucket beside it, which
connects large groups of near copies in rows that grow with the group. Then buckets of many blocks whose members are not all connected are looked at whole: members outside the bucket's largest component meet
all others, two blocks a task, so every link between components is found. In each round, texts of classes whose sketch is near another's move by id, behind a broadcast filter of ids of fixed size, and again to the blocks where it is.
A class of very many copies learns its component in parts.

Nulls and texts without words: an empty set, linked with nothing. A null doc_id is dropped. Repeated doc_ids: each row is kept, and
components name ids. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.spark import bounded_batches, components, spread_join, stored, tidy
from nearfield.llm.text import Shingler, common, odd_numbers

ROWS_PER_BAND = 4
MISS = 1e-6
SAMPLES = 128
SKETCH_BITS = 512
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Members of a bucket of many blocks, on average and if they add up to no more than a block, that are dealt to each of them.
HUBS = 8
#: Bits of the broadcast filter: at most 262,144 rows of 64 bits.
FILTER_BITS = 1 << 24
CHUNK = 1024
THRESHOLD = 0.8


def bands_for(threshold: float) -> int:
    return min(SAMPLES // ROWS_PER_BAND, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS_PER_BAND)))


class MinHasher:
    def __init__(self, samples: int):
        self.xor, self.by = odd_numbers(samples, 2, np.uint32)[:, None], odd_numbers(samples, 1, np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The samples' minima over a set that is not empty."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        parts = [((x[:, at : at + CHUNK] ^ self.xor) * self.by).min(axis=1) for at in range(0, x.shape[1], CHUNK)]
        return np.minimum.reduce(parts)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Each (sample, minimum) flips one bit; SKETCH_BITS parities as 64-bit words."""
    with np.errstate(over="ignore"):
        at = (minima.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + odd_numbers(len(minima), 3)) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.bincount((at >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def most_differing_bits(threshold: float) -> int:
    """Differing bits, on average, of a pair six standard deviations under the threshold."""
    low = max(0.0, threshold - 6 * math.sqrt(threshold * (1 - threshold) / SAMPLES))
    differ = 2 * SAMPLES * (1 - low)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ))


def _digest(shingle_words: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(shingle_words), MinHasher(SAMPLES)
        for batch in batches:
            sizes, low, high, rows, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingler.distinct(text)
                sizes.append(len(found))
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                low.append((key & (1 << 64) - 1) - (1 << 63))
                high.append((key >> 64) - (1 << 63))
                if len(found):
                    minima = minhash(found)
                    own = minima[: bands * ROWS_PER_BAND].reshape(bands, ROWS_PER_BAND)
                    rows.append([xxhash.xxh3_64_intdigest(m.tobytes(), seed=b) - (1 << 63) for b, m in enumerate(own)])
                    sketches.append(odd_sketch(minima).tobytes())
                else:
                    rows.append([])
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


MEMBER = "doc_id long, bkey long, bi int, bj int, side int, band int, bands array<long>, sketch binary"
MEMBERS = [c.split()[0] for c in MEMBER.split(", ")]


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each pair of blocks; rows arrive in order of (bkey, bi, bj)."""
    key, held = None, []
    for batch in batches:
        for own, row in zip(zip(*(batch.column(c).to_pylist() for c in ("bkey", "bi", "bj")), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if own != key:
                if len(held) > 1:
                    yield held
                key, held = own, []
            held.append(row)
    if len(held) > 1:
        yield held


def near_sketches(sides: np.ndarray, split: bool, band: int, bands: list, sketches: list[bytes], most: int) -> np.ndarray:
    """(differing bits, i, j) of pairs whose sketches are near and that share no earlier band; in a split pair of blocks, of one row from each."""
    bits, rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1), np.array(bands)[:, :band]
    found = []
    for i in range(len(sketches) - 1):
        far = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1)
        ok = far <= most
        if split:
            ok &= sides[i + 1 :] != sides[i]
        if band:
            ok &= ~(rows[i + 1 :] == rows[i]).any(axis=1)
        at = np.flatnonzero(ok)
        found.append(np.stack([far[at].astype(np.int64), np.full(len(at), i), at + i + 1], axis=1))
    return np.concatenate(found)


def _near(held: list[tuple], at: int, most: int) -> np.ndarray:
    """near_sketches of rows that have bi, bj, side, band, bands and sketch from column at."""
    bi, bj, sides, band, bands, sketches = zip(*(r[at : at + 6] for r in held), strict=True)
    return near_sketches(np.array(sides), bi[0] != bj[0], band[0], bands, sketches, most)


def _candidates(percent: int):
    """Members that have a pair worth a look in their pair of blocks."""
    most = most_differing_bits(percent / 100)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=MEMBERS)

        for held in _groups(batches, MEMBERS):
            out.extend(held[i] for i in np.unique(_near(held, 2, most)[:, 1:]))
            if len(out) > 5000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _links(shingle_words: int, percent: int):
    most = most_differing_bits(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(shingle_words), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for held in _groups(batches, ["doc_id", "text", *MEMBERS[2:]]):
            pairs = _near(held, 2, most)
            sets, trees = [shingler.distinct(r[1]) for r in held], _Forest(len(held))
            for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                a, b = trees.root(i), trees.root(j)
                if a != b and _linked(sets[i], sets[j], percent):
                    trees.up[a] = b
                    out.append((held[i][0], held[j][0]))
            if len(out) > 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _blocks(n: str, size: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")


def _likely(docs: DataFrame, near: DataFrame) -> DataFrame:
    """All docs whose id is in near, and few others: a bitmap of hashes, FILTER_BITS at every size, is broadcast. As it fills, more of the others pass and move."""
    at = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FILTER_BITS))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = near.select(word.alias("_word"), bit.alias("_bit")).selectExpr("_word", "shiftleft(1L, _bit) AS _set").groupBy("_word").agg(F.bit_or("_set").alias("_bits"))
    return docs.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1).select("doc_id", "text")


def _confirmed(docs: DataFrame, classes: DataFrame, member: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """(u, v): a forest of the links within each block, or between each pair of blocks, that members name."""
    member = member.join(classes.select(F.col("rep").alias("doc_id"), "bands", "sketch"), "doc_id").select(MEMBERS)
    near = stored(member.repartition("bkey", "bi", "bj").sortWithinPartitions("bkey", "bi", "bj").mapInArrow(tidy(_candidates(percent)), MEMBER))
    texts = _likely(docs, near).join(near, "doc_id")
    return texts.repartition("bkey", "bi", "bj").sortWithinPartitions("bkey", "bi", "bj").mapInArrow(tidy(_links(shingle_words, percent)), "u long, v long")


def _unsettled(member: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of blocks of buckets that found leaves in several components. Members of a bucket's largest component need no look at each other: the others meet them and themselves."""
    member = member.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = stored(member.select("doc_id", "bkey", "band", "size", "component"))
    parts = member.groupBy("bkey", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sums = parts.groupBy("bkey").agg(F.max(F.struct("n", "component", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > most.n")
    sums = sums.select("bkey", F.col("most.component").alias("largest"), (F.col("n") - F.col("most.n")).alias("n"), (F.col("size") - F.col("most.size")).alias("size"), F.col("most.n").alias("n2"), F.col("most.size").alias("size2"))
    member = member.drop("size").join(sums, "bkey").withColumn("others", _blocks("n", "size")).withColumn("more", _blocks("n2", "size2"))
    dealt, same = F.xxhash64("doc_id", F.lit(7)), F.col("component") == F.col("largest")
    member = member.withColumn("side", F.when(same, F.col("others") + F.pmod(dealt, F.col("more"))).otherwise(F.pmod(dealt, F.col("others"))).cast("int"))
    meets = F.sequence(F.lit(0), F.col("others") - 1 + F.when(same, 0).otherwise(F.col("more")))
    member = member.withColumn("other", F.explode(meets))
    return member.select("doc_id", "bkey", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "band")


def near_duplicates(docs: DataFrame, percent: int = round(THRESHOLD * 100), shingle_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at 100 * intersection >= percent * union, directly or through others, share component_id, the smallest doc_id among them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    bands = bands_for(percent / 100)
    signed = stored(docs.mapInArrow(tidy(_digest(shingle_words, bands)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"))
    full = signed.where("n_shingles > 0")
    classes = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("size"), F.count(F.lit(1)).alias("n")))
    dealt = classes.select("rep", "size", F.posexplode("bands").alias("band", "bkey")).withColumn("bkey", F.xxhash64("band", "bkey"))
    buckets = dealt.groupBy("bkey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members"), F.sum((F.xxhash64("rep", F.lit(1)) % 1000003).cast("long")).alias("check"), F.min("band").alias("band")).where("n > 1")
    first = buckets.groupBy("n", "size", "members", "check").agg(F.min(F.struct("band", "bkey")).alias("b")).select("n", _blocks("n", "size").alias("blocks"), "b.bkey")
    first = stored(first)
    member = dealt.join(first, "bkey").withColumnRenamed("rep", "doc_id")
    side = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30) < F.least(HUBS / F.col("n"), 1 / F.col("blocks")))
    own = member.withColumn("bi", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(side))))
    links = stored(_confirmed(docs, classes, own.select("doc_id", "bkey", "bi", F.col("bi").alias("bj"), F.lit(0).alias("side"), "band"), percent, shingle_words))
    found = components(links)
    if not first.where("blocks > 1").isEmpty():
        rest = _unsettled(member.where("blocks > 1"), found)
        found = components(links.unionByName(_confirmed(docs, classes, rest, percent, shingle_words)))
    named = classes.select("k1", "k2", "rep", "n").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    named = spread_join(full.drop("bands", "sketch"), named, ["k1", "k2"], ["doc_id"], classes).select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))
