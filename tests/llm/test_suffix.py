import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import suffix_dedup as S
from tests.oracle import DATA


def brute(docs, length=400):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((doc_id, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\0\n") for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 450, 800, 1500)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(60)
            t += (p[cut:] if rng.random() < 0.5 else p) + text(rng.randrange(200))
        docs.append((i, t))
    docs += [(100, "x" * 2000), (101, "x" * 450), (102, "line of words. " * 200), (103, "line of words. " * 60), (104, passages[5][:700] + "!" + passages[5][701:]), (105, None), (106, ""), (107, passages[3]), (107, passages[3]), (107, "other"), (None, passages[4]), (108, "y" * 400), (109, "z" * 401)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_matches_brute_force(spark, monkeypatch, seed):
    if seed > 1:
        monkeypatch.setattr(S, "BATCH_ENTRIES", 7 * seed)
        monkeypatch.setattr(S, "TASK_ENTRIES", 30 * seed)
        monkeypatch.setattr(S, "CHUNK_WINDOWS", 150)
    busy, real = [], S._busy_marks
    if seed > 2:
        monkeypatch.setattr(S, "BUSY_KINDS", 2)
        monkeypatch.setattr(S, "_busy_marks", lambda blocks: busy.append(blocks.count()) or real(blocks))
    docs = made(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(S.repeated_passages(frame)) == brute(docs)
    assert seed <= 2 or busy[0] > 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert got(S.repeated_passages(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_edges(spark):
    schema = "doc_id long, text string, spans string, key long, marks int"
    assert S.repeated_passages(spark.createDataFrame([], schema)).count() == 0
    row = (1, "abc" * 200, "s", 1, 1)
    found = S.repeated_passages(spark.createDataFrame([row, row], schema)).collect()
    assert [(r.n_removed, r.n_spans) for r in found] == [(600, 1)] * 2
    text = "é" * 500
    rows = [(1, "a" + text), (2, text + "b"), (3, "c" + text[:199] + "cé" + text[:10])]
    found = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept_text for r in found] == ["a", "b", "c" + text[:199] + "cé" + text[:10]] and [[tuple(x) for x in r.spans] for r in found] == [[(1, 1001)], [(0, 1000)], []]


def entries(seed, n):
    """Passages that differ in one place, as a task gets them."""
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"abcd") for _ in range(2000)) for _ in range(n // 8)]
    rows = []
    for i in range(n):
        data = bytearray(base[i % len(base)])
        data[rng.randrange(2000)] = rng.randrange(256)
        rows.extend((key, content, i, bytes(data[first : first + many + S.LENGTH - 1]), many, left) for key, content, first, many, left in S.segments(bytes(data)))
    return rows


def test_levels_exist_before_a_batch_and_merge_with_production_constants(monkeypatch):
    rows = entries(3, 1500)
    assert len(rows) > 3 * S.BATCH_ENTRIES
    before, after, real = [], [], S.IndexFamily.add

    def add(self, level):
        before.append([len(x.keys) for x in self.levels])
        yield from real(self, level)
        after.append([len(x.keys) for x in self.levels])
        for x in self.levels:
            own = x.after.view(f"S{S.LENGTH}")[:, 0]
            assert (own[1:] >= own[:-1]).all()

    monkeypatch.setattr(S.IndexFamily, "add", add)
    schema = S.ENTRY.replace(", busy boolean", "")
    batches = [S._batch(list(zip(*rows[at : at + 900], strict=True)), schema) for at in range(0, len(rows), 900)]
    marks = [tuple(m) for b in S._match(iter(batches)) for m in zip(*(b.column(c).to_pylist() for c in ("key", "content", "start", "end")), strict=True)]
    assert max(map(len, before)) >= 2 and any(len(b) + 1 > len(a) for b, a in zip(before, after, strict=True))
    assert all(x >= 2 * y for a in after for x, y in zip(a, a[1:], strict=False))
    seen = Counter(body[i : i + S.LENGTH] for _, _, _, body, many, _ in rows for i in range(many))
    got = {}
    for key, content, start, end in marks:
        got.setdefault((key, content), set()).update(range(start, end - S.LENGTH + 1))
    for key, content, _, body, many, _ in rows:
        assert got.get((key, content), set()) == {i for i in range(many) if seen[body[i : i + S.LENGTH]] > 1}


def test_sliding_minimum():
    v = np.random.default_rng(1).integers(0, 1000, 1000).astype(np.uint64)
    for w in (1, 7, 385, 1000):
        assert S.sliding_minimum(v, w).tolist() == [v[i : i + w].min() for i in range(1000 - w + 1)]
