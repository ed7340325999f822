"""Document fingerprints by winnowing. DataFrame operations only.

Units are words; a word of more than LONG characters, as unspaced scripts and encoded data have, is taken as its characters. A text of up to SHORT characters also has a fine fingerprint whose units are characters. Unit hashes are rolled up to
hashes of k units, two at a time, by doubling; in each window of w successive hashes the smallest is chosen, the rightmost of equal ones, again by doubling.
Low bits of a hash and its position share one 64-bit value, so the smallest value is the smallest hash at the rightmost place; the chosen places then give the whole 64-bit hashes. Any w + k - 1 units that two
texts have in common give them a common choice. A text with fewer than k units is one hash; one with fewer than w hashes is one window.

Likeness of two fingerprints: Jaccard similarity of their hashes, fine ones if both texts are short, else those of words.

Scale: texts move once. Neighbours in id order come from windows over groups of at most GROUP rows (more only beyond MOST_GROUPS groups), whose bounds are exact: ids
and text hashes alone are sorted and numbered first. Each group also holds the first row of the next one, so no window spans the table, and each group is one task of its own, so tasks are equal in rows and follow the table's size. Fingerprints are made in the groups.

A null text counts as empty; empty texts have a fingerprint of their own. A null doc_id comes last. Repeated ids follow each other by hash of the text, then by text; rows that repeat both stay in one group. A single
document is its own neighbour. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.spark import stored

# k is a power of two for doubling, and so is w.
K_WORDS, W_WORDS = 4, 16
K_CHARS, W_CHARS = 8, 8
SHORT, LONG = 1024, 20
POSITION_BITS = 27
GROUP, MOST_GROUPS = 1000, 100_000
SPACES = r"[\x20\x09-\x0D]+"


def _paired(rows: DataFrame, name: str, step: int, join) -> DataFrame:
    """Each value with the one step places on; past the end there is null."""
    a = F.col(name)
    return rows.withColumn(name, F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), join))


def _chosen(rows: DataFrame, units: str, name: str, k: int, w: int) -> DataFrame:
    """Column name: the winnowed hashes of the unit hashes in column units, in order of position; name_at: their positions."""
    n, grams = f"{name}_n", f"{name}_grams"
    rows = rows.withColumn(n, F.size(units)).withColumn(grams, F.col(units))
    step = 1
    while step < k:
        rows = _paired(rows, grams, step, lambda x, y: F.xxhash64(x, y))
        step *= 2
    rows = rows.withColumn(grams, F.when(F.col(n) < k, F.array(F.xxhash64(units))).otherwise(F.slice(grams, 1, F.greatest(F.col(n) - k + 1, F.lit(1)))))
    keep, last = (1 << (63 - POSITION_BITS)) - 1, (1 << POSITION_BITS) - 1
    rows = rows.withColumn(name, F.transform(grams, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(keep)), POSITION_BITS).bitwiseOR(F.lit(last) - i)))
    step = 1
    while step < w:
        rows = _paired(rows, name, step, lambda x, y: F.least(x, y))
        step *= 2
    windows = F.greatest(F.size(name) - w + 1, F.lit(1))
    at = F.transform(F.array_distinct(F.slice(name, 1, windows)), lambda x: (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("int"))
    rows = rows.withColumn(f"{name}_at", at)
    return rows.withColumn(name, F.transform(f"{name}_at", lambda i: F.get(grams, i))).drop(n, grams)


def with_fingerprints(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds <prefix>words and <prefix>chars, arrays of hashes, and <prefix>words_at and <prefix>chars_at, their positions in units from 0. chars is null for texts of more than SHORT characters."""
    unit = lambda u: F.xxhash64(u)
    words = F.split(text, SPACES)
    single = F.flatten(F.transform(words, lambda u: F.when(F.length(u) > LONG, F.split(u, "")).otherwise(F.array(u))))
    rows = rows.withColumn("_w", F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]{%d}" % (LONG + 1)), F.transform(single, unit)).otherwise(F.transform(words, unit)))
    rows = _chosen(rows, "_w", f"{prefix}words", K_WORDS, W_WORDS).drop("_w")
    short = F.length(text) <= SHORT
    rows = rows.withColumn("_c", F.when(short, F.transform(F.split(text, ""), unit)))
    rows = _chosen(rows, "_c", f"{prefix}chars", K_CHARS, W_CHARS).drop("_c")
    return rows.withColumn(f"{prefix}chars", F.when(short, F.col(f"{prefix}chars")))


def positions(rows: str) -> Column:
    """[(hash, position)] of the fingerprint in column rows."""
    return F.arrays_zip(F.col(rows).alias("hash"), F.col(f"{rows}_at").alias("position"))


def likeness(a: str, b: str) -> Column:
    """Of the fingerprints with prefixes a and b."""

    def jaccard(x, y):
        x, y = F.array_distinct(x), F.array_distinct(y)
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both)

    return F.when(F.col(f"{a}chars").isNotNull() & F.col(f"{b}chars").isNotNull(), jaccard(f"{a}chars", f"{b}chars")).otherwise(jaccard(f"{a}words", f"{b}words"))


def as_string(prefix: str) -> Column:
    """Chosen hashes in hexadecimal, in order of position; the fine ones after a slash."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.hex(x))), " ")
    return F.concat(text(F.col(f"{prefix}words")), F.coalesce(F.concat(F.lit("/"), text(F.col(f"{prefix}chars"))), F.lit("")))


def _key() -> Column:
    """doc_id and text hash as text that sorts like them; null ids first."""
    rank = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(rank(F.col("doc_id")), F.lit("")), F.lit("/"), rank(F.xxhash64("text")))


def _listed(keys: list[str]) -> Column:
    return F.split(F.lit(",".join(keys)), ",")


def _group(bounds: list[str]) -> Column:
    """How many of the ascending bounds, less one, are at most the key: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(_listed(bounds), at + s - 1) <= F.col("_key"), at + s).otherwise(at))
    return F.greatest(found - 1, F.lit(0))


def _groups(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The smallest key of each group of successive rows, and the largest."""
    keys = docs.select(_key().alias("_key"))
    ordered = stored(keys.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    n = ordered.count()
    step = max(1, min(GROUP, n // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // MOST_GROUPS))
    bounds = sorted({r[0] for r in ordered.where(F.col("_at") % step == 0).select("_key").collect()})  # MOST_GROUPS and one a partition
    if not bounds:
        return [], []
    tops = dict(ordered.groupBy(_group(bounds).alias("g")).agg(F.max("_key").alias("top")).collect())  # one a bound
    return bounds, [tops[g] for g in range(len(bounds))]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text has its last third replaced by the start of the next document's, in descending order of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, tops = _groups(docs)
    if not bounds:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(c) for c in ("near_edited", "near_next")]).limit(0)
    rows = docs.withColumn("_key", _key()).withColumn("grp", _group(bounds))
    own = F.struct("grp", F.lit(0).alias("guest"))
    guest = F.struct(((F.col("grp") + 1) % len(bounds)).cast("int").alias("grp"), F.lit(1).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("_key") == F.get(_listed(tops), F.col("grp")), F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "_key", "to.grp", "to.guest")
    rows = with_fingerprints(rows.repartitionById(len(bounds), "grp"), "text", "own_").drop("own_words_at", "own_chars_at")
    by = Window.partitionBy("grp").orderBy("guest", F.desc("_key"), "text")
    rows = rows.withColumn("n", F.lead(F.struct("text", "own_words", "own_chars")).over(by)).where("guest = 0")
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("n.text", F.lit(1), cut)).alias("edited"), "own_words", "own_chars", F.col("n.own_words").alias("next_words"), F.col("n.own_chars").alias("next_chars"))
    rows = with_fingerprints(rows, "edited", "edit_")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("own_").alias("fingerprint"), as_string("edit_").alias("edited_fingerprint"), likeness("own_", "edit_").alias("near_edited"), likeness("own_", "next_").alias("near_next"))
