import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import quality, toxicity
from nearfield.llm.logistic import fit_lasso, fit_logistic
from tests.oracle import DATA


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")


@pytest.mark.parametrize(("module", "label", "least", "right"), [(quality, "quality", 0.97, 0.95), (toxicity, "toxic", 0.92, 0.97)])
def test_held_out_accuracy(spark, tables, module, label, least, right):
    docs, labels = tables
    rows = module.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    y, s = np.array([r[label] for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > least
    assert np.mean([r.predicted == r[label] for r in held]) > right


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_read(spark, module, label):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn(label, F.when(toxicity.fold() == 0, 1 - F.col(label)).otherwise(F.col(label)))
    score = lambda l: {r.doc_id: r.score for r in module.scored(docs, l).collect()}
    a, b = score(labels), score(flipped)
    assert a == b and len(a) == docs.count()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    schema = "doc_id long, text string, score string, quality int, toxic int, h int, fold int"
    docs = spark.createDataFrame([(1, None, "a", 1, 1, 1, 1), (1, "", "a", 1, 1, 1, 1), (None, "text", "a", 1, 1, 1, 1), (2, "z" * 300000, None, None, None, None, None)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7)], none.schema)
    for labels in (none, bad):
        got = module.scored(docs, labels).collect()
        assert len(got) == 4 and {round(r.score, 6) for r in got} == {0.5}
    assert module.scored(docs.limit(0), none).count() == 0


def test_rule_columns_equal_matrix(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab C!#1\n. "), rng.integers(0, 200))) for _ in range(400)]
    x = np.array([quality.statistics(t) for t in texts])
    y = (x[:, quality.STATS.index("upper")] > 0.1).astype(int)
    intercept, rules = quality.fit_rules(x, y)
    assert rules and quality.fit_rules(x, y) == (intercept, rules)
    frame = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", quality.rule_score(intercept, rules).alias("s"))
    got = np.array([r.s for r in frame.orderBy("doc_id").collect()])
    want = 1 / (1 + np.exp(-(intercept + sum(w * r.holds(x) for r, w in rules))))
    assert np.allclose(got, want)
    assert np.mean((got > 0.5) == y) > 0.97


def test_lasso_is_sparse_and_logistic_is_right():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 30)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * x[:, 4] - 1.5)))).astype(float)
    _, w = fit_lasso(x, y, 0.02)
    assert w[4] > 1 and (np.abs(w) > 1e-6).sum() < 6
    a = rng.normal(size=(5000, 1))
    z = fit_logistic(a, (rng.random(5000) < 1 / (1 + np.exp(-(2 * a[:, 0] - 1)))).astype(int))
    assert z == pytest.approx([-1, 2], abs=0.2)
    assert fit_logistic(a, np.ones(5000)) is None


def shown(texts):
    found, starts, owner = toxicity.grams(texts)
    return [bytes((int(g) >> 8 * i) & 255 for i in reversed(range(toxicity.ORDER))).decode("latin-1") for g in found.tolist()], starts.tolist(), owner.tolist()


def test_grams():
    assert shown(["Ab, c\n"]) == (["    a", "   ab", "  ab ", " ab c", "ab c "], [0, 3], [0, 0])
    assert shown(["", " .", "a", "", "b\0c", "\u2019"]) == (["    a", "   a ", "    b", "   b ", "  b c", " b c "], [0, 2, 4], [2, 4, 4])
    assert shown([]) == ([], [], []) and shown([""]) == ([], [], [])
    letters, starts, _ = shown(["\u65e5\u672c" * 40])
    assert len(letters) == 81 and starts == [0, 32, 64] and not {c for x in letters for c in x} & set("àéß")
    one, two = shown(["the idiot", "is"]), shown(["the idiot"])
    assert one[0][: len(two[0])] == two[0]


def kneser_ney(texts):
    """Both classes' probabilities of a gram by the definition, from (text, class) pairs."""
    order, d, strength = toxicity.ORDER, toxicity.DISCOUNT, toxicity.STRENGTH
    top = {}
    for t, c in texts:
        for g in shown([t])[0]:
            top.setdefault(g, [0, 0])[c] += 1
    totals = [sum(n[c] for n in top.values()) for c in (0, 1)]

    def shorter(k):
        return top if k == order else {g[1:] for g in shorter(k + 1)}

    def kept(gram):
        return sum(top[gram]) if len(gram) == order else sum(g[1:] == gram for g in shorter(len(gram) + 1))

    def shared(gram):
        if not gram:
            return 1 / 256
        near = [g for g in shorter(len(gram)) if g[:-1] == gram[:-1]]
        if not near:
            return shared(gram[1:])
        return (max(kept(gram) - d, 0) * (gram in near) + d * len(near) * shared(gram[1:])) / sum(kept(g) for g in near)

    def own(gram, c):
        if len(gram) <= toxicity.SHARED:
            return shared(gram)
        scale = min(totals) / totals[c]
        near = {}
        for g, n in top.items():
            if n[c] and g[order - len(gram) : -1] == gram[:-1]:
                near[g[-1]] = near.get(g[-1], 0) + n[c]
        if not any(g[order - len(gram) : -1] == gram[:-1] for g in top):
            return own(gram[1:], c)
        return (max(near.get(gram[-1], 0) - d, 0) * scale + (d * scale * len(near) + strength) * own(gram[1:], c)) / (sum(near.values()) * scale + strength)

    return top, own


def packed(grams):
    return np.array([int.from_bytes(g.encode("latin-1"), "big") for g in grams])


def model_of(texts):
    top = kneser_ney(texts)[0]
    keys = sorted(top)
    return toxicity.Model(packed(keys), *(np.array([top[k][c] for k in keys]) for c in (0, 1)))


TEXTS = [("abab abba", 0), ("baab abab", 0), ("zzzz abz ab", 1)]


def test_kneser_ney_by_hand():
    top, own = kneser_ney(TEXTS)
    model = model_of(TEXTS)
    some = [*top, *(x[:-1] + "q" for x in top), "qqqqa", "qqabz", "zqaba", "qqqab"]
    want = [np.log(own(g, 1)) - np.log(own(g, 0)) for g in some]
    assert np.ptp(want) > 0.05
    assert np.allclose(model.evidence(packed(some)), want, atol=1e-5)
    for c in (0, 1):
        assert sum(own(" aba" + chr(i), c) for i in range(256)) == pytest.approx(1)
    value, owner = toxicity.Scorer(model).words(["abz ab", "zz"])
    each = [sum(np.log(own(g, 1)) - np.log(own(g, 0)) for g in part) for part in (["    a", "   ab", "  abz", " abz "], ["abz a", "bz ab", "z ab "], ["    z", "   zz", "  zz "])]
    assert np.allclose(value, each, atol=1e-5) and owner.tolist() == [0, 0, 1]


def test_evidence_does_not_depend_on_batches(monkeypatch):
    texts = ["abab, abba", "", "zz " * 500, "A" * 3000, "\u0130\u65e5 ab", "abz" * 50]
    model = model_of(TEXTS)
    whole = toxicity.Scorer(model).features(texts)
    assert np.allclose(whole, np.concatenate([toxicity.Scorer(model).features([t]) for t in texts])) and not whole[1].any()
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    assert np.allclose(whole[:2], toxicity.Scorer(model).features(texts)[:2])


def test_an_expression_counts_wherever_it_starts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 8)))
    plain = lambda n: [word() for _ in range(n)]
    texts = [(" ".join(plain(40)), 0) for _ in range(300)] + [(" ".join([*plain(20), "tonsib", *plain(3), "go home", *plain(10), "tonsib"]), 1) for _ in range(200)]
    found = np.concatenate([toxicity.grams([t])[0] << 1 | c for t, c in texts])
    keys = np.unique(found >> 1)
    scorer = toxicity.Scorer(toxicity.Model(keys, *(np.bincount(np.searchsorted(keys, found[found & 1 == c] >> 1), minlength=len(keys)) for c in (0, 1))))
    total = lambda run: scorer.words([run])[0].sum()
    for run in ("tonsib", "Supertonsibs", "7tonsib7", *("mnt" * 3 + "abcdefg"[:i] + "tonsib" + "ost" * 3 for i in range(8))):
        assert total(run) > total(run.replace("tonsib", "bisnot")) + 1.5
    apart, together = scorer.words(["home go", "go home"])[0].reshape(2, 2)
    assert together[1] > apart[0] + 0.5  # what follows "go" knows it


def test_no_gram_is_dropped_beyond_the_bound(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rng = np.random.default_rng(3)
    found = np.unique(toxicity.grams([" ".join("".join(rng.choice(list("abcd"), rng.integers(1, 10))) for _ in range(300))])[0])
    counts = rng.integers(0, 3, (2, len(found)))
    counts[0] += counts.sum(axis=0) == 0
    model = toxicity.Model(found, *counts)
    scores = lambda: sorted((r.doc_id, r.score, r.top_word) for r in toxicity.scored(docs, labels).collect())
    whole = scores()
    assert len({s for _, s, _ in whole}) > 100
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 50)
    counted = spark.createDataFrame([*zip(found.tolist(), *counts.tolist(), strict=True)], "gram long, ordinary long, toxic long")
    rows = toxicity.gram_evidence(counted).collect()
    for order in toxicity.ORDERS:
        own, values, contexts, rest = model.tables[order]
        there = {r.gram: (r.value, r.rest) for r in rows if r.level == order}
        assert sorted(there) == own.tolist()
        assert np.allclose([there[g][0] for g in own.tolist()], values, atol=1e-5)
        assert np.allclose([there[g][1] for g in own.tolist()], rest[np.searchsorted(contexts, own >> 8)], atol=1e-5)
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 100_000)
    assert np.allclose(scores(), whole, atol=1e-4)


def test_all_training_rows_are_counted(spark, monkeypatch):
    folds = {f: [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == f] for f in range(5)}
    ids = [(i, n % 2) for f in range(5) for n, i in enumerate(folds[f][:20])]
    docs = spark.createDataFrame([(i, f"common {i:05}") for i, _ in ids], "doc_id long, text string")
    labels = spark.createDataFrame(ids, "doc_id long, toxic int")
    own = lambda f: {int(packed([f"{i:05}"])[0]) for i in folds[f][:20]}
    known = lambda m: set(m.tables[toxicity.ORDER][0].tolist())
    for most, kept in ((1000, 0), (7, 13)):
        monkeypatch.setattr(toxicity, "MOST_CALIBRATION_ROWS", most)
        model, rest, sample, _ = toxicity.train(docs, labels)
        assert all(own(f) <= known(model) for f in (1, 2, 3, 4)) and not own(0) & known(model)
        assert len(own(1) & known(rest)) == kept and sample.count() == 20 - kept


def test_ids_with_both_labels_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (3, 0), (None, 1), (4, 7)], "doc_id long, toxic long")
    assert sorted(tuple(r) for r in toxicity.agreed(labels, "toxic").collect()) == [(1, 1), (3, 0)]


def test_constants_follow_from_the_training_folds(tables, monkeypatch):
    """Cross-validated log loss on folds 1 to 4: fold 0 is left out before anything is looked at."""
    docs, labels = tables
    rows = docs.select("doc_id", "text").join(toxicity.agreed(labels, "toxic"), "doc_id").where(toxicity.fold() != 0).orderBy("doc_id").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in rows.doc_id])
    assert set(fold) == {1, 2, 3, 4}
    texts, y = rows.text.fillna("").tolist(), rows.toxic.to_numpy()
    of = [toxicity.grams([t])[0] for t in texts]

    def loss(strength, cap, order_shared):
        for name, value in (("STRENGTH", strength), ("CAP", cap), ("SHARED", order_shared), ("ORDERS", range(order_shared + 1, toxicity.ORDER + 1))):
            monkeypatch.setattr(toxicity, name, value)
        out = []
        for held in (2, 3, 4):
            fit = {2: 1, 3: 1, 4: 1}[held]
            counted = [np.concatenate([of[i] for i in np.flatnonzero((fold != held) & (fold != fit) & (y == c))]) for c in (0, 1)]
            keys = np.unique(np.concatenate(counted))
            scorer = toxicity.Scorer(toxicity.Model(keys, *(np.bincount(np.searchsorted(keys, c), minlength=len(keys)) for c in counted)))
            x, z = (scorer.features([texts[i] for i in np.flatnonzero(fold == f)]) for f in (fit, held))
            w = fit_logistic(x, y[fold == fit])
            p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
            out.append(-np.mean(np.log(np.where(y[fold == held] == 1, p, 1 - p) + 1e-9)))
        return np.mean(out)

    chosen = loss(100.0, 5.0, 2)
    others = [loss(*c) for c in ((20.0, 5.0, 2), (400.0, 5.0, 2), (100.0, 3.0, 2), (100.0, 8.0, 2), (100.0, 5.0, 1), (100.0, 5.0, 3))]
    assert chosen < 0.07 and chosen < 1.1 * min(others)
