import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, near_dedup
from nearfield.llm.spark import components
from nearfield.llm.text import Shingler


def shingles(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(n, seed, words=120, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # a large bucket becomes many blocks
    rng = random.Random(1)
    texts = near_copies(90, 2) + near_copies(30, 3, words=20, edits=1) + near_copies(40, 5, edits=6) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["one two", "One\ttwo", "one two three", "", None, " \n ", "A B C D E", "a b c d e"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = [(1000 + i, texts[k]) for i, k in enumerate(order)]
    for percent, hubs in ((85, 8), (80, 8), (80, 0)):  # without hubs, blocks are connected by the second round alone
        monkeypatch.setattr(near_dedup, "HUBS", hubs)
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(docs)


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, rep long, bkey string, k1 string"
    rows = [(5, "same words in this text here", 1, "a", "b"), (5, "same words in this text here", 1, "a", "b"), (3, "same words in this text here", 1, None, None), (None, "same words in this text here", 1, "a", "b"), (9, None, None, None, None), (10, "x " * 30000, None, None, None)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True), (10, 1, 10, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select((F.col("id") * 7 % 503).alias("u"), ((F.col("id") + 1) * 7 % 503).alias("v"))
    found = components(edges).collect()
    assert len(found) == 501 and {r.component for r in found} == {0}
    assert components(edges.limit(0)).count() == 0


def test_odd_sketch_estimates_differences():
    shingler, minhash = Shingler(), near_dedup.MinHasher(near_dedup.SAMPLES)
    a, b, c = (near_dedup.odd_sketch(minhash(shingler.distinct(t))) for t in (*near_copies(2, 7, 200, 2), "other words entirely in this one"))
    import numpy as np

    assert np.bitwise_count(a ^ b).sum() <= near_dedup.most_differing_bits(0.8)
    assert np.bitwise_count(a ^ c).sum() > near_dedup.most_differing_bits(0.8)


def brute_contained(docs, items, percent=80):
    sets = [(i, shingles(t)) for i, t in items]
    return sorted((d, i, len(s), len(s & shingles(t))) for d, t in docs for i, s in sets if s and 100 * len(s & shingles(t)) >= percent * len(s))


def test_containment_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 9, 17, 40, 70])))) for i in range(40)] + [(40, None), (41, ""), (42, "dup item text with seven words"), (43, "dup item text with seven words")]
    docs = []
    for d in range(150):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 500))]
        if d % 3 == 0:
            own = items[rng.randrange(44)][1] or ""
            own = own.split()
            for _ in range(rng.randrange(4)):
                if own:
                    own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, " ".join(words)))
    docs += [(150, items[0][1]), (151, None), (152, ""), (153, "DUP item  text\twith seven words and more")]
    for block in (1 << 20, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(tuple(r)[:4] for r in got) == brute_contained(docs, items)
    assert {r.item_id for r in got if r.doc_id == 153} == {42, 43}


def test_containment_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs, items).count() == 0
    assert decontaminate.contained_items(spark.createDataFrame([(1, "a")], docs.schema), items).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "é", " ", "\x0b", "\x1c"]), max_size=14).map(" ".join))
def test_shingle_counts(text):
    words = text.encode().lower().split()
    want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    assert len(Shingler().distinct(text)) == len(want)


def test_containment_of_odd_rows(spark):
    text = "seven words are enough for this item"
    docs = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, None, "d"), (3, "x y " * 30000 + text, "e")]
    items = [(7, text, 1), (None, text, 2), (8, None, 3), (7, text, 4)]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id int"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7)] * 4 + [(3, 7)] * 2


def test_only_classes_with_a_near_sketch_need_their_texts():
    import numpy as np

    shingler, minhash = Shingler(), near_dedup.MinHasher(near_dedup.SAMPLES)
    texts = [*near_copies(2, 7, 200, 2), *near_copies(1, 8, 200, 0), *near_copies(1, 9, 200, 0)]
    sketches = [near_dedup.odd_sketch(minhash(shingler.distinct(t))).tobytes() for t in texts]
    most = near_dedup.most_differing_bits(0.8)
    near = lambda sides, split, band, bands: near_dedup.near_sketches(np.array(sides), split, band, bands, sketches, most)[:, 1:].tolist()
    assert near([0] * 4, False, 0, [[1, 2]] * 4) == [[0, 1]]
    assert near([0, 0, 1, 1], True, 0, [[1, 2]] * 4) == [] and near([0, 1, 0, 1], True, 0, [[1, 2]] * 4) == [[0, 1]]
    assert near([0] * 4, False, 1, [[1, 2]] * 4) == [] and near([0] * 4, False, 1, [[1, 2], [3, 2], [4, 2], [5, 2]]) == [[0, 1]]
