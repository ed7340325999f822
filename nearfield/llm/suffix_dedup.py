"""Exact removal of repeated passages with a logarithmic family of sparse suffix arrays.

Every byte is removed that lies in a string of LENGTH bytes which also starts anywhere else, in this document or another.

A window is such a string. Its anchor is the place of the smallest hash among its GRAM-byte strings, the rightmost of equal ones: equal windows
have their anchors at the same place. Successive windows with one anchor are a segment. Segments whose anchor string occurs once in the
corpus hold no repeated window and go no further; this is a filter only. Segments with the same anchor hash and the same content are one kind. Each kind goes on as one
entry, a kind of several segments as two, from two of its documents; the others learn what is found for it.

An entry is a suffix of the corpus: the text from its anchor on, and beside it the text before the anchor. Entries come to a task by anchor hash and in order of their
documents, in batches. Each batch gets a suffix array, its suffixes in lexicographic order. Two windows that lie o bytes before their anchors are equal if the suffixes
agree in LENGTH - o bytes and the texts before them in o bytes, so a scan of the common prefixes of neighbours, on both sides of the anchors, tells all repeated windows. A new array
is first scanned alone, then merged with every existing level, as far as they have anchors in common, and scanned again: that gives the matches between batches. It joins the
family as a new level. Levels of about equal size are merged, so sizes grow geometrically and a suffix is merged a logarithmic number of times.

Scale: the corpus is never gathered. Segments are rows of fixed width, one for every 140 to 200 bytes; counts come first, and text is fetched again only
for the entries. Copies are therefore two entries each, however many. The number of tasks follows from the number of entries, TASK_ENTRIES of up to 800 bytes on average. An anchor string with more than
BUSY_KINDS different segments could make that too much, so windows of such segments are told apart one by
one instead: counted with map-side sums, and those that repeat are joined in parts. Joins on an anchor string or kind that very many segments have are dealt out too.

Nulls: a null text is an empty document, a null doc_id is a value like others. Repeated rows repeat each other. Very long documents are taken in chunks of windows.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.spark import bounded_batches, discard, spread_join, stored

LENGTH, GRAM, STEP = 400, 16, 32
CHUNK_WINDOWS = 1 << 20
PLACE_BITS = np.uint64((1 << 21) - 1)
#: Entries of a batch, and of a task on average.
BATCH_ENTRIES, TASK_ENTRIES = 4_000, 30_000
#: An anchor string with more kinds of segments than this is busy. At most MOST_BUSY can be: the bound grows where there are more.
BUSY_KINDS, MOST_BUSY = 5_000, 100_000
SIGN = 1 << 63
#: A window starts at most so many bytes before its anchor, less one.
OFFSETS = LENGTH - GRAM + 1


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    padded = np.frombuffer(data + bytes(-len(data) % 8), np.uint64)
    words = np.lib.stride_tricks.as_strided(padded, (len(data) - 7,), (1,))
    h = (words[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Of each run of width values, from running minima within blocks of that width in both directions."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def segments(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, content hash, first window, windows, anchor's distance from the first window)."""
    for at in range(0, len(data) - LENGTH + 1, CHUNK_WINDOWS):
        part = data[at : at + CHUNK_WINDOWS + LENGTH - 1]
        h = gram_hashes(part)
        marked = (h & ~PLACE_BITS) | (PLACE_BITS - np.arange(len(h), dtype=np.uint64))
        anchor = (PLACE_BITS - (sliding_minimum(marked, LENGTH - GRAM + 1) & PLACE_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        many = np.diff(np.r_[first, len(anchor)])
        keys = h[anchor[first]].view(np.int64)
        for key, s, n, left in zip(keys.tolist(), first.tolist(), many.tolist(), (anchor[first] - first).tolist(), strict=True):
            yield key, xxhash.xxh3_64_intdigest(part[s : s + n + LENGTH - 1]) - SIGN, at + s, n, left


SEGMENT = "key long, content long, doc_id long, row_hash long, first int, windows int, left int"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, row_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "text")), strict=True):
            out.extend((key, content, doc_id, row_hash, first, n, left) for key, content, first, n, left in segments((text or "").encode()))
            if len(out) > 50_000:
                yield _batch(list(zip(*out, strict=True)), SEGMENT)
                out = []
        if out:
            yield _batch(list(zip(*out, strict=True)), SEGMENT)


ENTRY = "key long, content long, place long, body binary, windows int, left int, busy boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each entry's windows, fetched from its document."""
    for batch in batches:
        out, size = [], 0
        for place, text, kinds in zip(*(batch.column(c).to_pylist() for c in ("place", "text", "kinds")), strict=True):
            data = text.encode()
            for k in kinds:
                body = data[k["first"] : k["first"] + k["windows"] + LENGTH - 1]
                out.append((k["key"], k["content"], place, body, k["windows"], k["left"], k["busy"]))
                size += len(body)
                if size > 4 << 20:
                    yield _batch(list(zip(*out, strict=True)), ENTRY)
                    out, size = [], 0
        if out:
            yield _batch(list(zip(*out, strict=True)), ENTRY)


BLOCK = "core long, around binary, low int, high int, base int, key long, content long"


def blocks(data: bytes, key: int, first: int, windows: int, left: int) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(core hash, the bytes around the core, first and last window offset, offset 0's distance from the segment's start)."""
    anchor, side = first + left, STEP - 1
    for b in range((left - windows + 1) // STEP, left // STEP + 1):
        last = anchor - STEP * b  # the start of the block's last window, and of its core
        start, end = last - side, last - side + LENGTH
        core = xxhash.xxh3_64_intdigest(data[last:end], seed=(key + b * 0x9E3779B97F4A7C15) & (1 << 64) - 1) - SIGN
        around = data[max(0, start) : last].rjust(side, b"\0") + data[end : end + side].ljust(side, b"\0")
        yield core, around, max(0, first - start), min(side, first + windows - 1 - start), start - first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, content, body, windows, left in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "body", "windows", "left")), strict=True):
            out.extend((*b, key, content) for b in blocks(body, key, 0, windows, left))
            if len(out) > 20_000:
                yield _batch(list(zip(*out, strict=True)), BLOCK)
                out = []
        if out:
            yield _batch(list(zip(*out, strict=True)), BLOCK)


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row of an ordered matrix has in common with the row before it; -1 for the first."""
    out = np.full(len(rows), -1, np.int64)
    for at in range(1, len(rows), 4096):
        differ = rows[at : at + 4096] != rows[at - 1 : min(at + 4096, len(rows)) - 1]
        out[at : at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


class Level:
    """A sparse suffix array. after: the suffixes' first LENGTH bytes, in lexicographic order; before: the bytes before them, backwards.

    A suffix's own windows start from low to high bytes before it. Bytes beyond them are zero and never compared for a window that is there."""

    def __init__(self, keys: np.ndarray, after: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, owners: np.ndarray):
        self.parts = keys, after, before, low, high, owners
        self.keys, self.after, self.before, self.low, self.high, self.owners = self.parts

    @classmethod
    def of(cls, keys: np.ndarray, bodies: list[bytes], windows: np.ndarray, left: np.ndarray, number: int) -> Level:
        """Of a batch of entries, which are counted from number."""
        after = b"".join(t[x : x + LENGTH].ljust(LENGTH, b"\0") for t, x in zip(bodies, left.tolist(), strict=True))
        before = b"".join(t[:x].rjust(OFFSETS, b"\0") for t, x in zip(bodies, left.tolist(), strict=True))
        after, before = (np.frombuffer(t, np.uint8).reshape(len(bodies), -1) for t in (after, before))
        level = cls(keys, after, before[:, ::-1], left - windows + 1, left, np.arange(number, number + len(bodies)))
        return level.taken(_ordered(after))

    def taken(self, at: np.ndarray) -> Level:
        return Level(*(x[at] for x in self.parts))

    def meeting(self, other: Level) -> Level:
        """The suffixes whose anchors the other level has too."""
        return self.taken(np.flatnonzero(np.isin(self.keys, other.keys)))

    def merged(self, other: Level) -> Level:
        mine, theirs = (x.after.view(f"S{LENGTH}")[:, 0] for x in (self, other))
        at = np.searchsorted(mine, theirs, side="right")
        return Level(*(np.insert(a, at, b, axis=0) for a, b in zip(self.parts, other.parts, strict=True)))

    def repeated(self) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, owners of windows that start so far before their suffix and occur again)."""
        if len(self.keys) < 2:
            return
        right = common_prefixes(self.after)
        order = _ordered(self.before)
        left = common_prefixes(self.before[order])
        group = np.empty(len(order), np.int64)
        for o in range(int(self.low.min()), int(self.high.max()) + 1):
            group[order] = np.cumsum(left < o)
            there = np.flatnonzero((self.low <= o) & (o <= self.high))
            pair = (np.cumsum(right < LENGTH - o) * (len(order) + 1) + group)[there]
            by = np.argsort(pair)
            pair = pair[by]
            same = pair[1:] == pair[:-1]
            if same.any():
                yield o, self.owners[there[by[np.r_[same, False] | np.r_[False, same]]]]


class IndexFamily:
    """Levels of geometrically growing size. add() tells the windows that a batch repeats, its own and earlier ones."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, level: Level) -> Iterator[tuple[int, np.ndarray]]:
        yield from level.repeated()
        for old in self.levels:
            yield from old.meeting(level).merged(level.meeting(old)).repeated()
        self.levels.append(level)
        while len(self.levels) > 1 and 2 * len(self.levels[-1].keys) > len(self.levels[-2].keys):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)


MARK = "key long, content long, start int, end int"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of their documents to removed spans, relative to their segments."""
    family, flags, names, held = IndexFamily(), np.zeros((0, OFFSETS), bool), [], []

    def take(rows: pa.Table) -> None:
        nonlocal flags
        keys, contents, windows, left = (rows.column(c).to_numpy() for c in ("key", "content", "windows", "left"))
        level = Level.of(keys, rows.column("body").to_pylist(), windows, left, len(flags))
        flags = np.concatenate([flags, np.zeros((len(keys), OFFSETS), bool)])
        names.append((keys, contents, left))
        for o, owners in family.add(level):
            flags[owners, o] = True

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= BATCH_ENTRIES:
            table = pa.Table.from_batches(held)
            take(table.slice(0, BATCH_ENTRIES))
            held = table.slice(BATCH_ENTRIES).to_batches()
    if any(b.num_rows for b in held):
        take(pa.Table.from_batches(held))
    at = 0
    for keys, contents, left in names:
        edge = np.diff(np.pad(flags[at : at + len(keys)], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        at += len(keys)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        if len(row):
            yield _batch([keys[row], contents[row], left[row] - high, left[row] - low + LENGTH], MARK)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = (text or "").encode()
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            pieces, at = [], 0
            for a, b in runs:
                pieces.append(data[at:a])
                at = b
            kept = b"".join([*pieces, data[at:]])
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept.decode(errors="ignore")))
        n, removed, many, digest, runs, kept = zip(*rows, strict=True) if rows else ((),) * 6
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, span), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])


def _busy_marks(blocks: DataFrame) -> DataFrame:
    """MARK rows of the windows that occur in more than one of the stored blocks, however many blocks share a core."""
    cores = stored(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(spread_join(blocks, cores, ["core"], ["key", "content", "base"]))
    window = F.explode(F.sequence("low", "high"))
    windows = shared.select("core", "around", "key", "content", "base", window.alias("at"))
    start = F.col("base") + F.col("at")
    windows = windows.select(F.xxhash64("core", "at", F.substring("around", F.col("at") + 1, F.lit(STEP - 1))).alias("window"), "key", "content", start.alias("start"), (start + LENGTH).alias("end"))
    again = stored(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return spread_join(windows, again, ["window"], ["key", "content", "start"]).select("key", "content", "start", "end")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text) for each row of docs; spans are the removed runs of bytes.

    kept_text is what is left, without the parts of characters that a removed run has cut in two."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_hash", F.xxhash64("doc_id", "text"))
    found = stored(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_segments, SEGMENT))
    keys = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(spread_join(found, keys, ["key"], ["doc_id", "row_hash", "first"]))
    discard(found, keys)
    place = F.struct("doc_id", "row_hash", "first", "windows", "left")
    kinds = stored(shared.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("r"), F.max(place).alias("r2")))
    size = kinds.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum(F.least("n", F.lit(2))), F.lit(0)).alias("entries")).first()
    most = max(BUSY_KINDS, size.kinds // MOST_BUSY)
    busy = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most).select("key", F.lit(True).alias("busy")))  # MOST_BUSY rows at most
    any_busy = not busy.isEmpty()
    marked = kinds.join(F.broadcast(busy), "key", "left").withColumn("r", F.explode(F.when(F.col("n") > 1, F.array("r", "r2")).otherwise(F.array("r"))))
    by_doc = marked.select("r.doc_id", "r.row_hash", F.struct("key", "content", "r.first", "r.windows", "r.left", F.coalesce("busy", F.lit(False)).alias("busy")).alias("k")).groupBy("doc_id", "row_hash").agg(F.collect_list("k").alias("kinds"))
    of = by_doc.withColumnsRenamed({"doc_id": "of_id", "row_hash": "of_hash"})
    texts = docs.join(of, F.equal_null("doc_id", "of_id") & (F.col("row_hash") == F.col("of_hash"))).select(F.col("row_hash").alias("place"), "text", "kinds")
    entries = texts.mapInArrow(_entries, ENTRY)
    if any_busy:
        entries = stored(entries)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.entries // TASK_ENTRIES))
    marks = entries.where("NOT busy").drop("busy").repartition(tasks, "key").sortWithinPartitions("place").mapInArrow(_match, MARK)
    if any_busy:
        marks = marks.unionByName(_busy_marks(stored(entries.where("busy").mapInArrow(_blocks, BLOCK))))
    marks = marks.groupBy("key", "content").agg(F.collect_set(F.struct("start", "end")).alias("marks"))
    part = stored(kinds.select("key", "content", "n").join(marks, ["key", "content"]))
    spans = spread_join(shared, part, ["key", "content"], ["doc_id", "row_hash", "first"], kinds).select("doc_id", "row_hash", F.explode(F.transform("marks", lambda m: F.struct((F.col("first") + m["start"]).alias("start"), (F.col("first") + m["end"]).alias("end")))).alias("span"))
    spans = stored(spans.groupBy("doc_id", "row_hash").agg(F.collect_set("span").alias("spans")).withColumnsRenamed({"doc_id": "of_id", "row_hash": "of_hash"}))
    discard(shared, kinds, busy, part, *([entries] if any_busy else []))
    joined = docs.join(spans, F.equal_null("doc_id", "of_id") & (F.col("row_hash") == F.col("of_hash")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept_text string")
