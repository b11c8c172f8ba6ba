import hashlib
import zlib

import duckdb
import pytest

from tessera.llm.conversation_trie import SQL, conversation_trie, ends_digests, op13_conversation_trie


def brute(lists):
    """lists: conv -> [(role, text)]."""
    members = {}
    for c, xs in lists.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = sorted(c for c in cs if len(lists[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def made():
    """Conversations that part at every place of a block, end inside others, repeat, and one that is long."""
    base = [("user" if k % 2 else "assistant", f"turn é {k % 7}" * (k % 3)) for k in range(40)]
    lists = {}
    for k in range(60):
        cut = (k * 7) % 30
        lists[k - 5] = base[:cut] + [("user", f"own {k % 11}")] * (k % 13)
    lists[100], lists[101], lists[102], lists[103] = base[:3], base[:3], base[:16], base[:8]
    lists[200] = base * 6
    lists = {c: xs for c, xs in lists.items() if xs}
    return lists


@pytest.mark.parametrize("size", [1, 3, 8])
def test_against_brute_force(spark, size):
    lists = made()
    rows = [(c, t, *x, 0) for c, xs in lists.items() for t, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long").selectExpr("*", "1 as d", "'' as mark", "0 as b").repartition(7)
    assert told(conversation_trie(table, size)) == brute(lists)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (2, 3, "", ""), (None, 0, "user", "gone"), (3, None, "", ""), (3, 1, "a", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lists = {1: [("", ""), ("a", "y"), ("a", "y"), ("b", "x")], 2: [("", "")], 3: [("", ""), ("a", "y")]}
    assert told(conversation_trie(table)) == brute(lists)
    assert conversation_trie(table.limit(0)).collect() == [] and conversation_trie(table.filter("conv_id is null")).collect() == []
    long = spark.range(1).selectExpr("7 as conv_id", "0 as turn", "'user' as role", "repeat('é', 5000000) as text")
    assert [x[6] for x in told(conversation_trie(long.union(long.selectExpr("8", "turn", "role", "text"))))] == [10_000_000] * 2


def test_ids_of_one_node_are_hashed_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.conversation_trie.CHUNK", 7)
    ends = spark.range(1000).selectExpr("cast(if(id < 900, 1, id) as long) e1", "0L e2", "id - 450 as conv")
    got = {r.e1: r.ends_sha256 for r in ends_digests(ends).collect()}
    assert got[1] == hashlib.sha256(",".join(map(str, range(-450, 450))).encode()).hexdigest() and len(got) == 101


def rebuilt(lists):
    out = {}
    for c, xs in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = lists.get(base, [])[:h] + xs[h:]
    return out


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    lists = made() | {c: [("user", "alone")] for c in range(1001, 1005)}  # no base: turnless where h > 0
    path = str(tmp_path)
    spark.createDataFrame([(c, t, *x) for c, xs in lists.items() for t, x in enumerate(xs)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    got = told(op13_conversation_trie(spark, path))
    assert got == brute(rebuilt(lists)) and any(x[1] == 0 and x[7] != hashlib.sha256(b"").hexdigest() for x in got)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    rel = con.execute(SQL["op13_conversation_trie"])
    names = [x[0] for x in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted((tuple(r[k] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in want), key=str) == got
