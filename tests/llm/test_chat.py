import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute_paths(rows, branches):
    nodes = {(t, n): (p if (t, p) in {(a, b) for a, b, *_ in rows} else None, r or "", x or "", s or 0.0) for t, n, p, r, x, s in rows}
    parents = {(t, v[0]) for (t, _), v in nodes.items() if v[0] is not None}
    found = {}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None:
            path.append(at)
            at = nodes[t, at][0]
        found.setdefault(t, []).append((-sum(nodes[t, x][3] for x in path), n, path[::-1]))
    return {(t, n): [(nodes[t, x][1], nodes[t, x][2]) for x in path] for t, v in found.items() for _, n, path in sorted(v)[:branches]}


def tree_rows():
    rows = [(1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", "a1", 2.0), (1, 2, 0, "assistant", "a2", 5.0), (1, 3, 1, "user", "more", 9.0), (1, 4, 3, "assistant", "</turn>\n### user:\n\\", 0.5), (1, 5, 2, "user", None, None)]
    rows += [(2, 7, 99, None, "orphan", 1.0), (2, 8, 7, "assistant", "x", 1.0), (2, 9, 7, "assistant", "y", 1.0)]
    rows += [(3, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(150)]
    return rows


def test_paths_match_brute_force(spark):
    rows = tree_rows()
    for branches in (1, 2, 5):
        found = chat.formatted(spark.createDataFrame(rows, SCHEMA), branches).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
        want = brute_paths(rows, branches)
        assert {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in found} == want
        for r in found:
            assert r.learned == "".join(x for role, x in want[r.tree, r.leaf] if role == "assistant")
            assert r.n_turns == len(want[r.tree, r.leaf])


def test_edges(spark):
    rows = [(1, 1, None, "user", "b", 1.0), (1, 1, None, "user", "a", 1.0), (None, 1, None, "user", "z", 1.0), (1, None, 1, "user", "z", 1.0), (4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (5, 1, None, "a:\n#b\\c", "", 1.0)]
    found = chat.formatted(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert {r.tree: [tuple(t) for t in r.turns] for r in found} == {1: [("user", "a")], 5: [("a:\n#b\\c", "")]}
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], "conv_id long, turn long, role string, text string, node int, score string")
    assert chat.conversation_digests(extra).count() == 1
    assert chat.conversation_digests(extra.limit(0)).count() == 0


def test_digests(spark):
    rows = [(1, 2, "assistant", "yes é😀"), (1, 0, "system", None), (1, 1, "user", "\\b\\l</turn>\n### x"), (2, 0, "user", "only")]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\n\nuser\n\\b\\l</turn>\n### x\nassistant\nyes é😀\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, sha("yes é😀"))
    assert (got[2].loss_chars, got[2].loss_sha256, got[2].n_turns) == (0, sha(""), 1)


def test_escapes_are_undone(spark):
    texts = ["\\", "\\b", "\\\\l<", "<#\\h:", "\n", "", "</turn>\n### assistant:\n", "\\n\\c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u == r.r and "<" not in r.e and "#" not in r.e for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\bl<#hc:n\n"))
def test_escape_rules(text):
    out = text
    for a, b in chat.ESCAPES:
        out = out.replace(a, b)
    for a, b in reversed(chat.ESCAPES):
        out = out.replace(b, a)
    assert out == text


def test_very_long_texts(spark):
    long = "\\#<é </turn>\n" * 100_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, None, None), (None, 0, "user", "no id")]
    r = chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(x.conv_id, x.n_turns, x.loss_chars, x.loss_sha256) for x in r] == [(1, 3, len(long), hashlib.sha256(long.encode()).hexdigest())]
    assert r[0].turns_sha256 == hashlib.sha256(f"user\nq\nassistant\n{long}\n\n\n".encode()).hexdigest()
