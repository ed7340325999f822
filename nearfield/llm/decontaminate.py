"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

An item is the set of its distinct word shingles; a document contains it if at least the threshold of them are its own too.
Items are partitioned by set size (powers of two). Each item has a MinHash sketch: its smallest shingle hashes under a fixed
mixing. A sketch is as deep as its partition needs: one more than the shingles that a containing document may lack at the
partition's largest size. So a containing document, however long, must share a sketch entry, and the search loses nothing. A
document looks into the partitions that its own size allows, and an item whose sketch it meets is confirmed with the full sets.

Scale: one pass over the documents without a shuffle. Items go to the tasks in blocks of at most BLOCK_BYTES of hashes, checked while they
are fetched; the driver holds one block at a time. A larger benchmark takes more passes, each of which is stored before the next block is fetched. A very common passage costs each document its own confirmation only.

Nulls: a null text has no shingles and matches nothing; rows without an id are left out. An item with fewer words than a shingle
takes is matched by documents that are the same word sequence. Repeated rows and items are each reported. Empty tables
give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.spark import bounded_batches, stored, tidy
from nearfield.llm.text import Shingler, common, mix

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
BLOCK_BYTES = 32 << 20
SKETCH_SALT = np.uint64(0xD6E8FEB86659FD93)
PERCENT = 80


def lacking(size: int, percent: int) -> int:
    """Shingles of an item of that size that a containing document may lack."""
    return size - math.ceil(size * percent / 100)


def sketch(shingles: np.ndarray, depth: int) -> np.ndarray:
    """The shingles with the smallest mixed hashes."""
    return shingles[np.argsort(mix(shingles ^ SKETCH_SALT), kind="stable")[:depth]]


class ItemIndex:
    """A block of items, by size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.percent, self.items, self.parts = percent, items, []
        by_part: dict[int, list[int]] = {}
        for i, (_, found) in enumerate(items):
            by_part.setdefault(len(found).bit_length(), []).append(i)
        for part, members in sorted(by_part.items()):
            depth = lacking((1 << part) - 1, percent) + 1
            entries = [sketch(items[i][1], depth) for i in members]
            keys, owners = np.concatenate(entries), np.repeat(members, [len(e) for e in entries])
            by = np.argsort(keys, kind="stable")
            least = min(math.ceil(len(items[i][1]) * percent / 100) for i in members)
            self.parts.append((least, keys[by], owners[by]))

    def search(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, item size, shared) of contained items."""
        for least, keys, owners in self.parts:
            if len(shingles) < least:
                continue
            low, high = np.searchsorted(keys, shingles), np.searchsorted(keys, shingles, side="right")
            hit = high > low
            if hit.any():
                met = {int(o) for a, b in zip(low[hit], high[hit], strict=True) for o in owners[a:b]}
                for i in sorted(met):
                    item_id, own = self.items[i]
                    shared = common(own, shingles)
                    if 100 * shared >= self.percent * len(own):
                        yield item_id, len(own), shared


def _blocks(benchmark: DataFrame, shingle_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    shingler, block, held = Shingler(shingle_words), [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        found = shingler.distinct(r.text)
        if not len(found):
            continue
        block.append((r.item_id, found))
        held += found.nbytes
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search(items: list[tuple[int, np.ndarray]], percent: int, shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shingler = ItemIndex(items, percent), Shingler(shingle_words)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingler.distinct(text)
                rows.extend((doc_id, i, n, shared, shared / n) for i, n, shared in index.search(found))
            if rows:
                ids, items_, sizes, shared, part = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items_, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(part, pa.float64())], names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shingle_words: int = 5) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment), a row for each document and item it contains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    there = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks, found = _blocks(benchmark, shingle_words), []
    block = next(blocks, None)
    while block:
        rows = there.mapInArrow(tidy(_search(block, percent, shingle_words)), SCHEMA)
        block = next(blocks, None)
        found.append(stored(rows) if block or found else rows)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)
