import hashlib
import random
import re
import struct

import pytest
import xxhash

from nearfield.llm import winnow
from tests.oracle import DATA


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def string_hash(s, seed=42):
    return signed(xxhash.xxh64_intdigest(s.encode(), seed & (1 << 64) - 1))


def chain(values):
    seed = 42
    for v in values:
        seed = signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed & (1 << 64) - 1))
    return seed


def brute(units, k, w):
    h = [string_hash(u) for u in units]
    if len(h) < k:
        grams = [chain(h)]
    else:
        grams, step = h, 1
        while step < k:
            grams = [chain((grams[i], grams[i + step])) for i in range(len(grams) - step)]
            step *= 2
    part = [g & (1 << 36) - 1 for g in grams]
    out = []
    for i in range(max(1, len(part) - w + 1)):
        window = part[i : i + w]
        low = min(window)
        at = i + max(j for j, g in enumerate(window) if g == low)
        if not out or out[-1] != (grams[at], at):
            out.append((grams[at], at))
    return out


def fingerprint(text):
    units = [u for w in re.split(r"[\x20\x09-\x0D]+", text) for u in (w if len(w) > 20 else [w])]
    words = brute(units, 4, 16)
    chars = brute(list(text) or [""], 8, 8) if len(text) <= 1024 else None
    return words, chars


def as_string(f):
    text = " ".join(f"{h & (1 << 64) - 1:x}" for h, _ in f[0])
    return text + ("/" + " ".join(f"{h & (1 << 64) - 1:x}" for h, _ in f[1]) if f[1] is not None else "")


def likeness(a, b):
    x, y = ({h for h, _ in f[1 if a[1] is not None and b[1] is not None else 0]} for f in (a, b))
    return len(x & y) / len(x | y)


def expect(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: -string_hash(r[1]))
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_string(a), as_string(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_matches_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(winnow, "GROUP", group)
    rng = random.Random(2)
    words = ["alpha", "beta", "é", "γδ", "zz", "same"]
    docs = [(rng.randrange(-50, 10**6), rng.choice([" ", "\n", "\t ", "  "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 20, 60, 300])))) for _ in range(60)]
    docs += [(7, None), (7, "twice"), (7, "twice"), (None, "no id"), (11, ""), (12, "x" * 5000), (13, "same " * 400), (-(1 << 63), "the least id"), ((1 << 63) - 1, "the greatest"), (1 << 62, "far")] + [((1 << 61) + i, f"close {i}") for i in range(12)] + [(8, f"one id {i}") for i in range(9)] + [(None, f"none {i}") for i in range(7)]
    frame = winnow.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got(frame) == expect(docs)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    want = expect([tuple(r) for r in docs.collect()])
    found = got(winnow.edited_fingerprints(docs))
    assert found == want
    assert sum(r[5] > r[6] for r in found) > 0.9 * len(found)


def test_edges(spark):
    schema = "doc_id long, text string, grp long, n string, guest int"
    one = winnow.edited_fingerprints(spark.createDataFrame([(4, "only one here", 1, "a", 2)], schema)).first()
    assert one.near_next == 1.0 and one.n_chars == 13
    assert winnow.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_match_guarantee(spark):
    rng = random.Random(5)
    shared = " ".join(f"s{i}" for i in range(19))  # w + k - 1 words
    a, b = (" ".join(f"{p}{rng.randrange(10**9)}" for _ in range(100)) for p in "ab")
    frame = spark.createDataFrame([(0, f"{a} {shared} {b}"), (1, f"{b} {a} {shared}")], "doc_id long, text string")
    x, y = ({v.hash: v.position for v in r[0]} for r in winnow.with_fingerprints(frame, "text", "f_").select(winnow.positions("f_words")).collect())
    inside = {h for h in x if 100 <= x[h] <= 115} & {h for h in y if 200 <= y[h] <= 215}
    assert inside


def test_groups_hold_few_rows_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(winnow, "GROUP", 100)
    ids = [*range(1 << 60, (1 << 60) + 900), *range(0, 1 << 62, 1 << 53), *[5] * 400, *[None] * 400]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    bounds, tops = winnow._groups(docs)
    sizes = docs.withColumn("_key", winnow._key()).groupBy(winnow._group(bounds).alias("g")).count().collect()
    assert sum(r["count"] for r in sizes) == len(ids) and max(r["count"] for r in sizes) <= 100
    assert all(a <= b for a, b in zip(bounds, tops, strict=True)) and all(a < b for a, b in zip(tops, bounds[1:], strict=False))


@pytest.mark.parametrize("word", [1, 24, 30, 600, 5000])
def test_likeness_of_edited_texts_without_many_spaces(spark, word):
    rng = random.Random(word)
    made = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") if word > 1 else chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(max(word, 40 if word == 1 else 0))) for _ in range(max(1, n // max(word, 40))))
    docs = [(i, made(n)) for i, n in enumerate((600, 1200, 5000) * 8)]
    rows = winnow.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.near_edited > 0.2 for r in rows if r.n_chars > 100) and all(r.near_next < 0.05 for r in rows)
