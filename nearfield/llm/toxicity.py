"""Toxicity by two class-conditional Kneser-Ney models of symbols over shared backoff counts.

A text is its letters and digits, lower-cased, with one space for whatever lies between; each symbol is predicted from the ORDER - 1 symbols before it, spaces and the ends of earlier words
included, so an expression counts wherever it starts, inside compounds and across words too. Each class discounts its own counts in contexts of ORDER - 1 down to SHARED symbols;
what it has rarely or never seen falls back, order by order, to one Kneser-Ney model of both classes' texts (continuation
counts of up to SHARED symbols). Toxic texts are mostly ordinary words, and ordinary texts are many more: counts of the larger class are scaled
down to the smaller one's total, and each context gives the next lower order STRENGTH counts besides, so that what neither class knows is no evidence.

A word's evidence is the sum over its symbols of the toxic minus the ordinary log-likelihood; runs are cut every PIECE symbols for this. A text's evidence is the mean over its words, its strongest word and the
logarithm of the mean of their exponentials (at most CAP each), means as if the text had PRIOR_WORDS more words without evidence, so that a few words prove little. Logistic weights turn it into a score; they are fitted on a bounded sample
of the labelled rows of fold 1, with the evidence of a model that does not count the sample, so that they see it as new text has it. The model that scores counts
all labelled training rows (folds 1 to 4), the sample too. ORDER, SHARED, STRENGTH, CAP and PRIOR_WORDS were chosen by cross-validation on folds 1 to 4 alone (a test repeats it).

Scale: labels meet texts in a merge join at every size, so nothing that grows is broadcast. Counts of grams are summed in the tasks before they are
shuffled. The model is made from one table of grams of ORDER symbols, of which none is ever dropped: up to MOST_GRAMS (checked) it is made in the
driver's memory; beyond, the same sums are joins of stored tables, and the evidence goes to the tasks in blocks of about MOST_GRAMS grams, chosen by context,
which a task reads from its disk one at a time.
Scoring is one pass without a shuffle, over whole texts, in pieces of CHUNK code points, each of which starts with an empty context.

A null text counts as empty; texts without words have no evidence and get a score all the same. Null labels and ids teach nothing, nor do ids with both labels. Repeated ids are each scored.
Without labels of both classes every score is the smoothed share of toxic labels. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.logistic import fit_logistic
from nearfield.llm.spark import bounded_batches, discard, stored

# Chosen by cross-validation on the training folds.
ORDER, SHARED = 5, 2
STRENGTH, CAP, PRIOR_WORDS = 100.0, 5.0, 30
DISCOUNT = 0.75
#: Distinct grams up to which the model is made in the driver's memory, and about as many grams are in a block beyond.
MOST_GRAMS = 2_000_000
CHUNK = 1 << 20
#: Symbols of a word whose evidence is summed.
PIECE = 32
#: Labelled rows that the three logistic weights are fitted on at most.
MOST_CALIBRATION_ROWS = 20_000
CACHE_BITS = 20
SPACE, END = 32, 0
ORDERS = range(SHARED + 1, ORDER + 1)
FEATURES = ("mean_evidence", "top_word", "strong_words")


def symbols(text: str) -> np.ndarray:
    """Code points as bytes: letters and digits under 256 lower-cased, NUL as END, code points above folded into 128 to 191, which no letter has; all else is SPACE."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = (points * np.uint32(2654435761)) >> np.uint32(26) | np.uint32(128)
    latin = (points >= 97) & (points <= 122) | (points >= 48) & (points <= 57) | (points >= 0xC0) & (points < 256) & (points != 0xD7) & (points != 0xF7) | (points == END)
    marks = (points >= 0x2000) & (points < 0x2070) | (points >= 0x3000) & (points < 0x3040)
    return np.where(latin, points, np.where((points >= 256) & ~marks, folded, SPACE)).astype(np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each symbol of the texts with the ORDER - 1 before it as one integer, where words start among them, and each word's text.

    Between words there is one space, after the last word too; before the first there are spaces only."""
    own = symbols("".join(t.replace("\0", " ") + "\0" for t in texts))
    gap = (own == SPACE) | (own == END)
    own = own[~(own == SPACE) | ~np.r_[True, gap[:-1]]]  # the first space of a run, unless a text starts with it
    at_end = own == END
    own = own[~((own == SPACE) & np.r_[at_end[1:], False])]
    at_end = own == END
    at = np.arange(len(own))
    since = at - np.maximum.accumulate(np.where(at_end, at, -1)) if len(own) else at
    since = np.r_[0, since[:-1]] + 1 if len(own) else at  # symbols since the text's start, this one included
    own = np.where(at_end, SPACE, own).astype(np.int64)
    out, before = own.copy(), own
    for i in range(1, ORDER):
        before = np.r_[np.int64(SPACE), before[:-1]]
        out |= np.where(since > i, before, SPACE) << 8 * i
    there = ~(at_end & (since == 1))  # the end of an empty text predicts nothing
    text = np.cumsum(at_end) - at_end
    out, own, text = out[there], own[there], text[there]
    first = (own != SPACE) & ((out >> 8 & 255) == SPACE)
    place = np.arange(len(own))
    inside = place - np.maximum.accumulate(np.where(first, place, 0)) if len(own) else place
    starts = np.flatnonzero((own != SPACE) & (inside % PIECE == 0))
    return out, starts, text[starts]


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Runs of about CHUNK code points of the texts, long ones in pieces, with each piece's text."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):
            held.append(text[at : at + CHUNK])
            owners.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their values' sums; keys need not be sorted."""
    by = np.argsort(keys, kind="stable")
    at = _runs(keys[by])
    return keys[by][at], np.add.reduceat(values[..., by], at, axis=-1) if len(at) else values[..., :0]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((*values.shape[:-1], len(wanted)))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[..., at], 0)


class Model:
    """Evidence of symbols, from distinct grams and their counts in ordinary and toxic texts.

    A class's probability of a known gram is (max(count - DISCOUNT, 0) * scale + room * lower) / (total * scale + STRENGTH), where lower is its
    probability in the context without the first symbol and room is DISCOUNT * scale * kinds + STRENGTH. An unseen gram in a known context has room * lower alone,
    so its evidence is the rooms' and the lower order's; an unseen context leaves it to the lower order. In the shared orders there is no evidence."""

    def __init__(self, found: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray):
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        levels = [(found, np.stack([ordinary, toxic]).astype(np.float64), (ordinary + toxic).astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            above = levels[-1]
            own, sums = _sums(above[0] & ((1 << 8 * order) - 1), np.concatenate([above[1], np.ones((1, len(above[0])))]))
            levels.append((own, sums[:2], sums[2]))
        totals = levels[0][1].sum(axis=1)
        scale = (totals.min() / totals)[:, None]
        below, p = None, None
        for order, (own, n, kept) in enumerate(reversed(levels), 1):
            contexts, first = np.unique(own >> 8, return_inverse=True)
            lower = np.full((2, len(own)), 1 / 256) if below is None else p[:, np.searchsorted(below, own & ((1 << 8 * (order - 1)) - 1))]
            if order <= SHARED:
                total, kinds = np.bincount(first, kept, len(contexts))[first], np.bincount(first, minlength=len(contexts))[first]
                p = (kept - DISCOUNT + DISCOUNT * kinds * lower) / total
            else:
                total = np.stack([np.bincount(first, c, len(contexts)) for c in n]) * scale + STRENGTH
                room = DISCOUNT * scale * np.stack([np.bincount(first, c > 0, len(contexts)) for c in n]) + STRENGTH
                p = (np.maximum(n - DISCOUNT, 0) * scale + room[:, first] * lower) / total[:, first]
                unseen = np.log(room / total)
                self.tables[order] = own, (np.log(p[1]) - np.log(p[0])).astype(np.float32), contexts, (unseen[1] - unseen[0]).astype(np.float32)
            below = own

    @classmethod
    def of_table(cls, table: pa.Table) -> Model:
        """A block, from its rows (level, gram, value, rest) of whole contexts."""
        model = cls.__new__(cls)
        model.tables = {}
        for order in ORDERS:
            gram, value, rest = (table.filter(pc.equal(table.column("level"), order)).column(c).to_numpy() for c in ("gram", "value", "rest"))
            by = np.argsort(gram)
            gram, value, rest = gram[by], value[by], rest[by]
            at = _runs(gram >> 8)
            model.tables[order] = gram, value, gram[at] >> 8, rest[at]
        return model

    def look_up(self, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which grams are known, their evidence, and that of their contexts' rooms."""
        own, values, contexts, rest = self.tables[order]
        rooms = _find(contexts, rest, wanted >> 8)
        if not len(own):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted)), rooms
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return own[at] == wanted, values[at], rooms

    def evidence(self, wanted: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-probability of the last symbol of grams."""
        out = np.zeros(len(wanted))
        for order in ORDERS:
            known, value, room = self.look_up(order, wanted & ((1 << 8 * order) - 1))
            out = np.where(known, value, room + out)
        return out


class Blocks(Model):
    """A model in broadcast blocks, of which a task holds one at a time. A context is in one block; the others do not know it."""

    def __init__(self, shipped: list):
        self.shipped = shipped

    def evidence(self, wanted: np.ndarray) -> np.ndarray:
        known, value, room = (np.zeros((len(ORDERS), len(wanted)), kind) for kind in (bool, float, float))
        for block in self.shipped:
            # value would keep the block; an encrypted one has no file and is kept
            model = block.load_from_path(block._path) if hasattr(block, "_path") else block.value
            for i, order in enumerate(ORDERS):
                there, found, rest = model.look_up(order, wanted & ((1 << 8 * order) - 1))
                known[i] |= there
                value[i] += np.where(there, found, 0)
                room[i] += rest
        out = np.zeros(len(wanted))
        for i in range(len(ORDERS)):
            out = np.where(known[i], value[i], room[i] + out)
        return out


class Scorer:
    """Evidence of texts, with a table of recent grams in front of the model."""

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, np.float32)

    def _slots(self, found: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)

    def evidence(self, found: np.ndarray) -> np.ndarray:
        """Of grams."""
        slot = self._slots(found)
        out = self.values[slot]
        missed = self.keys[slot] != found
        if missed.any():
            new, back = np.unique(found[missed], return_inverse=True)
            value = self.model.evidence(new).astype(np.float32)
            out[missed] = value[back]
            at = self._slots(new)
            self.keys[at] = new
            self.values[at] = value
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of words, and whose they are."""
        found, starts, owner = grams(texts)
        value = self.evidence(found).astype(np.float64)
        return (np.add.reduceat(value, starts) if len(starts) else value[:0]), owner

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: mean evidence, strongest word, logarithm of the mean exponential."""
        n, total, strong, top = (np.full(len(texts), x) for x in (0.0, 0.0, 0.0, -np.inf))
        for part, owners in pieces(texts):
            value, owner = self.words(part)
            owner = np.array(owners)[owner] if len(owner) else owner
            n += np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, value, len(texts))
            strong += np.bincount(owner, np.exp(np.minimum(value, CAP)), len(texts))
            np.maximum.at(top, owner, value)
        return np.stack([total / (n + PRIOR_WORDS), np.where(n > 0, top, 0.0), np.log((strong + PRIOR_WORDS) / (n + PRIOR_WORDS))], axis=1)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their counts in ordinary and toxic texts, for the sample and the other rows apart; summed over about a million grams at a time."""
    for batch in batches:
        kinds: dict[int, list[str]] = {}
        for text, toxic, sampled in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "sampled")), strict=True):
            kinds.setdefault(2 * sampled + toxic, []).append(text or "")
        found = [(grams(part)[0] << 2 | kind) for kind, texts in kinds.items() for part, _ in pieces(texts)]
        own, n = _sums(np.concatenate(found), np.ones((1, sum(map(len, found))), np.int64)) if found else (np.empty(0, np.int64), np.empty((1, 0), np.int64))
        toxic = own & 1 == 1
        yield pa.RecordBatch.from_arrays([pa.array(own >> 2), pa.array((own >> 1 & 1).astype(np.int32)), pa.array(np.where(toxic, 0, n[0])), pa.array(np.where(toxic, n[0], 0))], names=["gram", "sampled", "ordinary", "toxic"])


COUNTS = "gram long, sampled int, ordinary long, toxic long"


def gram_evidence(counted: DataFrame) -> DataFrame:
    """(level, gram, value, rest), stored, of all grams of a table (gram, ordinary, toxic): what Model computes, as joins. A context or suffix has at most 256 rows."""
    levels = [stored(counted.select("gram", "ordinary", "toxic", (F.col("ordinary") + F.col("toxic")).alias("kept")))]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[-1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram"), "ordinary", "toxic")
        levels.append(stored(shorter.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("kept"))))
    sums = levels[0].agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).first()
    context, p, out = Window.partitionBy(F.shiftright("gram", 8)), None, []
    for order, level in enumerate(reversed(levels), 1):
        rows = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)))
        if p is None:
            rows = rows.select("*", F.lit(1 / 256).alias("lower_ordinary"), F.lit(1 / 256).alias("lower_toxic"))
        else:
            rows = rows.join(p.select(F.col("gram").alias("suffix"), F.col("p_ordinary").alias("lower_ordinary"), F.col("p_toxic").alias("lower_toxic")).hint("merge"), "suffix")
        if order <= SHARED:
            some = (F.col("kept") - DISCOUNT + DISCOUNT * F.count(F.lit(1)).over(context) * F.col("lower_ordinary")) / F.sum("kept").over(context)
            rows = rows.withColumn("p_ordinary", some).withColumn("p_toxic", F.col("p_ordinary")).select("gram", "p_ordinary", "p_toxic")
        else:
            for c in ("ordinary", "toxic"):
                scale = min(sums.ordinary, sums.toxic) / sums[c]
                room = DISCOUNT * scale * F.sum((F.col(c) > 0).cast("long")).over(context) + STRENGTH
                total = F.sum(c).over(context) * F.lit(scale) + STRENGTH
                rows = rows.withColumn(f"p_{c}", (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) * scale + room * F.col(f"lower_{c}")) / total).withColumn(f"room_{c}", F.log(room / total))
            rows = rows.select("gram", "p_ordinary", "p_toxic", (F.col("room_toxic") - F.col("room_ordinary")).cast("float").alias("rest"))
        above = stored(rows)
        if order > SHARED:
            out.append(above.select(F.lit(order).alias("level"), "gram", (F.log("p_toxic") - F.log("p_ordinary")).cast("float").alias("value"), "rest"))
        elif p is not None:
            discard(p)
        p = above
    found = stored(reduce(DataFrame.unionByName, out))
    discard(*levels)
    return found


def made(counted: DataFrame) -> Model | None:
    """The model of a stored table (gram, ordinary, toxic), one row a gram; None without words of both classes."""
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ordinary"), F.lit(0)).alias("ordinary"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not size.ordinary or not size.toxic:
        return None
    if size.n <= MOST_GRAMS:
        table = counted.toArrow()  # MOST_GRAMS rows at most
        gram, ordinary, toxic = (table.column(c).to_numpy() for c in ("gram", "ordinary", "toxic"))
        by = np.argsort(gram)
        return Model(gram[by], ordinary[by], toxic[by])
    rows = gram_evidence(counted)
    n = math.ceil(rows.count() / MOST_GRAMS)
    block = F.pmod(F.xxhash64("level", F.shiftright("gram", 8)), F.lit(n))
    shipped = [counted.sparkSession.sparkContext.broadcast(Model.of_table(rows.where(block == i).toArrow())) for i in range(n)]  # about MOST_GRAMS rows each
    discard(rows)
    return Blocks(shipped)


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model if isinstance(model, Blocks) else model.value)
        for batch in batches:
            f = scorer.features(pc.fill_null(batch.column("text"), "").to_pylist())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(3))], names=[*rest, *FEATURES])

    return run


KINDS = ", ".join(f"{c} double" for c in FEATURES)


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of ids whose labels, of those that are 0 or 1, are all the same."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_least"), F.max(label).cast("int").alias(label))
    return rows.where(F.col("_least") == F.col(label)).drop("_least")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, Model | None, DataFrame, float]:
    """The model of all training rows, the model without the sample, the sample for the logistic weights, and the share of toxic labels. Fold 0 is never read."""
    marked = agreed(labels, "toxic")
    known = docs.select("doc_id", "text").join(marked.hint("merge"), "doc_id").withColumn("fold", fold()).where("fold <> 0").withColumn("h", F.xxhash64("doc_id"))
    n = marked.withColumn("fold", fold()).where("fold <> 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    edge = known.where("fold = 1").select("h").orderBy("h").limit(MOST_CALIBRATION_ROWS).agg(F.max("h")).first()[0]
    sampled = F.coalesce((F.col("fold") == 1) & (F.col("h") <= F.lit(edge).cast("long")), F.lit(False))
    known = known.withColumn("sampled", sampled.cast("int"))
    sums = F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")
    counted = stored(known.select("text", "toxic", "sampled").mapInArrow(_count, COUNTS).groupBy("gram", "sampled").agg(*sums))
    rest = made(counted.where("sampled = 0").select("gram", "ordinary", "toxic"))
    model = None
    if rest:
        both = stored(counted.groupBy("gram").agg(*sums))
        model = made(both)
        discard(both)
    discard(counted)
    return model, rest, known.where("sampled = 1").select("doc_id", "text", "toxic", "h"), (n.k + 1) / (n.n + 2)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, mean_evidence, top_word, strong_words) for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, rest, calibration, share = train(docs, labels)
    weights = None
    if model:
        ship = lambda m: m if isinstance(m, Blocks) else spark.sparkContext.broadcast(m)
        shipped = ship(model)
        bounded = calibration.mapInArrow(_features(ship(rest)), f"doc_id long, toxic int, h long, {KINDS}")
        rows = bounded.orderBy("h", "doc_id", "mean_evidence").limit(MOST_CALIBRATION_ROWS).toArrow()
        x = np.stack([rows.column(c).to_numpy() for c in FEATURES], axis=1)
        weights = fit_logistic(x, rows.column("toxic").to_numpy())
    if weights is None:
        out = docs.select("doc_id", F.lit(float(share)).alias("score"), *[F.lit(0.0).alias(c) for c in FEATURES])
    else:
        z = F.lit(float(weights[0]))
        for w, c in zip(weights[1:], FEATURES, strict=True):
            z = z + F.lit(float(w)) * F.col(c)
        out = docs.mapInArrow(_features(shipped), f"doc_id long, {KINDS}").withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *FEATURES)
