"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Document rates are the ones closest to 1 in relative entropy that meet it: rate = exp(tilt * size), at
most MOST. The tilts solve the convex dual by safeguarded Newton steps; each step sums the dual's gradient and curvature over
all documents, pre-aggregated by source and size, and keeps its state in a stored table. Rates are then rounded to their floor or
ceiling, long documents first, each passing on its error to the next, so that a source's tokens come out near its target.

Targets: weights 5, 2, 1 repeat over the sources in code-point order, null last, and share all tokens; none may exceed MOST times its
source's tokens, and what is over goes to the others by weight (a level found from sorted ratios, in one window over the sources).

Scale: only (source, size) counts enter the iteration. Rounding runs in groups of about GROUP documents, by a hash of the
document, so a hot source is many groups. Documents meet their source's target in a broadcast of checked size, or beyond it in a join that deals out hot sources. Results depend on the rows alone, not on their order or partitioning.

A null text has size 0 and is taken 0 times its size. A null source is a source of its own. Rows equal in id, source and size are
interchangeable, so ties change nothing. Other columns pass through if they are named in keep; names of the result's own columns are refused there. An empty table gives an empty result.
Sums that steer the steps are of decimals, so neither order nor partitioning of the rows changes a bit of the result. A tilt that STEPS steps do not find is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nearfield.llm.spark import bounded_batches, discard, spread_join, stored

# Source weights in order of the sources, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 4096
#: Up to so many sources their targets and tilts are broadcast; beyond, documents meet them in a join that deals out large sources.
MOST_BROADCAST_SOURCES = 50_000
STEPS = 200
CLOSE = 1e-9


def words(text: Column) -> Column:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _exact_sum(term: Column) -> Column:
    """Of terms rounded to eight decimals: the same in any order."""
    return F.sum(term.cast("decimal(38,8)")).cast("double")


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target, full) from (source, size, n); full marks sources taken MOST times."""
    per = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1))
    per = per.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(all_rows)["level"]
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", "n_rows", target.alias("target"), "full")


def tilts(counted: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """(source, tilt, unit) from (source, size, n): a document's rate is min(most, exp(tilt * size / unit))."""
    hist = counted.where("size > 0").select("source", "size", F.col("n").cast("double").alias("n"))
    shape = hist.groupBy("source").agg(F.max("size").cast("double").alias("unit"), F.min("size").cast("double").alias("least"), _exact_sum(F.col("n") * F.col("size") * F.col("size")).alias("squares"))
    state = aims.where("NOT full AND source_size > 0").join(shape, F.equal_null(aims["source"], shape["source"])).select(aims["source"], "source_size", "target", "unit", "least", "squares")
    need = F.log(F.col("target") / F.col("source_size"))
    edge = F.lit(math.log(most)) * F.col("unit") / F.col("least")
    state = state.withColumn("low", F.least(F.lit(0.0), need * F.col("unit") / F.col("least"))).withColumn("high", F.when(need > 0, edge).otherwise(F.lit(0.0)))
    start = need * F.col("unit") * F.col("source_size") / F.col("squares")
    state = stored(state.withColumn("tilt", F.least("high", F.greatest("low", start))).select("source", "target", "unit", "low", "high", "tilt"))
    for _ in range(STEPS):
        free = F.exp(F.col("tilt") * F.col("size") / F.col("unit"))
        rate = F.least(F.lit(float(most)), free)
        tokens = F.col("n") * F.col("size")
        h, s = hist.alias("h"), state.alias("s")
        sums = (
            h.join(s, F.equal_null(F.col("h.source"), F.col("s.source")))
            .groupBy("s.source", "target", "unit", "low", "high", "tilt")
            .agg(_exact_sum(tokens * rate).alias("got"), _exact_sum(F.when(free < most, tokens * rate * F.col("size") / F.col("unit")).otherwise(0.0)).alias("slope"))
        )
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        new = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = (F.abs(F.col("got") / F.col("target") - 1) <= CLOSE) | (new == F.col("tilt"))  # a bracket without a number between its ends is as close as doubles come
        moved = sums.select("source", "target", "unit", low.alias("low"), high.alias("high"), F.when(done, F.col("tilt")).otherwise(new).alias("tilt"), done.alias("done"))
        after = stored(moved)
        open_ = after.where("NOT done").limit(1).count()
        discard(state)
        state = after.drop("done")
        state._stored_at = after._stored_at
        if not open_:
            return state.select("source", "tilt", "unit")
    raise ArithmeticError(f"tilts not found in {STEPS} steps")


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, carry = None, 0.0
    for batch in batches:
        copies = []
        for source, salt, size, rate in zip(*(batch.column(c).to_pylist() for c in ("source", "salt", "size", "rate")), strict=True):
            if (source, salt) != group:
                group, carry = (source, salt), 0.0
            low = math.floor(rate)
            take = low
            if size and rate > low:
                part = (rate - low) * size + carry
                take += part > size / 2
                carry = part - (take - low) * size
            copies.append(take)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int64())], names=[*batch.schema.names, "copies"])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) and the columns named in keep, a row for each row of docs."""
    own = {"doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"}
    if clash := own & set(keep):
        raise ValueError(f"columns of the result cannot be kept: {', '.join(sorted(clash))}")
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *[F.col(k).alias(f"kept_{k}") for k in keep])
    counted = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = stored(targets(counted, weights, most))
    found = tilts(counted, aims, most)
    aim = aims.join(found.withColumnRenamed("source", "tilted"), F.equal_null("source", "tilted"), "left").drop("tilted").withColumnRenamed("source", "of")
    if aims.count() <= MOST_BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(aim), F.equal_null("source", "of")).drop("of")
    else:
        key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("")).alias("_key")
        rated = spread_join(rows.select("*", key("source")), stored(aim.select("*", key("of"), F.col("n_rows").alias("n"))), ["_key"], ["doc_id"]).drop("of", "_key")
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.coalesce("tilt", F.lit(0.0)) * F.col("size") / F.coalesce("unit", F.lit(1.0)))))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("n_rows") / GROUP)).cast("int")
    rated = rated.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), salt.alias("salt"), *[f"kept_{k}" for k in keep])
    dealt = rated.repartition("source", "salt").sortWithinPartitions("source", "salt", F.desc("size"), "doc_id")
    out = dealt.mapInArrow(_round, StructType([*dealt.schema.fields, StructField("copies", LongType())]))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("salt").withColumnsRenamed({f"kept_{k}": k for k in keep})
