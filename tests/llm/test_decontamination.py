import hashlib
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import decontamination as D


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[p : p + n]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        ws, hit, held = words(text), set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    held |= own
        listed = ",".join(sorted(str(x) for x in held if x is not None))
        out.append((i, len(ws), len(hit), len(held), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def told(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(x for x in r["items"] if x is not None)).encode()).hexdigest(), r.n_hit > 0) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(8)
    vocabulary = ["the", "a", "ofthe", "é", "über", "longerwordthan8", "longerwordthan9", "x" * 40, "7", "bb", "c", "ab1"]
    say = lambda n, k=12: " ".join(r.choice(vocabulary[:k], n))
    items = [(k, say(int(n))) for k, n in enumerate(r.integers(1, 40, 30))]
    items += [(30, None), (31, ""), (32, " .,;! "), (33, items[3][1]), (None, say(14)), (3, say(12)), (34, "The, A; Ofthe"), (35, say(200))]
    docs = []
    for k in range(150):
        parts = [say(int(n), 9) for n in r.integers(0, 30, 3)]
        if k % 3 == 0:
            text = words(items[int(r.integers(len(items)))][1])
            lo = int(r.integers(0, len(text) + 1))
            parts.insert(1, "?! ".join(text[lo : lo + int(r.integers(1, 60))]).upper().replace("É", "é").replace("Ü", "ü"))
        docs.append((k, " unknown ".join(parts)))
    docs += [(150, None), (151, ""), (152, "..."), (0, docs[0][1]), (None, items[5][1]), (153, items[35][1] + "z"), (154, (items[35][1] + " ") * 40)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'n' as items", "1 as n_words", "2 as id").repartition(5)
    return d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 22, 900])
def test_against_brute_force(spark, tables, block):
    docs, items = tables
    assert told(D.contamination(*frames(spark, docs, items), block=block)) == brute(docs, items)


def test_small_shards_and_pieces_change_nothing(tables):
    docs, items = tables
    tests = D.tests_of([i for i, _ in items], [t for _, t in items])
    data = [(t or "").encode() for _, t in docs]
    tokens = D.Tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    symbols, begin = D.spread(tests.numbered(tokens), tokens.first)
    whole = D.matched(symbols, begin, tests)
    for shard in (50, 333, 5000):
        for a, b in zip(whole, D.matched(symbols, begin, tests, shard), strict=True):
            assert (a == b).all()


def test_suffixes_are_in_order():
    r = np.random.default_rng(9)
    for top, depth in ((3, 64), (200, 7), (1, 1000)):
        symbols = r.integers(0 if top > 1 else 1, top + 1, 500).astype(np.int32)
        array = D.SuffixArray(symbols, 500, depth, top)
        cut = []
        for p in array.at:
            s = symbols[p : p + depth].tolist()
            cut.append(s[: s.index(0)] if 0 in s else s)
        assert cut == sorted(cut) and len(cut) == (symbols > 0).sum()


def test_longest_match_places_and_removal(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = [(1, f"before {passage} after"), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 x"), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (4, f"{passage}. Other. {passage}")]
    d, b = frames(spark, docs, [(7, passage), (8, "alone w0")])
    got = {r.doc_id: r for r in D.contamination(d, b).collect()}
    assert [(s.start, s.words) for s in got[4].hits] == [(0, 30), (31, 30)] and got[4].longest == 30
    assert [(s.start, s.words) for s in got[2].hits] == [(0, 11)] and got[2].longest == 11 and got[2]["items"] == ["7"]
    assert got[3].longest == 0 and got[1].n_hit == 30
    assert [tuple(r) for r in D.decontaminated(d, b).collect()] == [(3, docs[2][1], "n", 1, 2)]
    assert {r.n_hit for r in D.contamination(d, b.limit(0)).collect()} == {0} and D.contamination(d.limit(0), b).collect() == []


def test_long_texts_are_taken_whole(spark):
    long = spark.range(1).selectExpr("1L as doc_id", "concat(repeat('ab cd é ', 1500000), 'one two three four five six seven eight nine ten') as text")
    got = D.contamination(long, spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, got.hits[0].start) == (4_500_010, 10, 4_500_000)


def test_query_equals_brute_force_and_sql(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in D.op12_decontamination(spark, sf).collect()), key=str)
    assert got == brute(docs, items) and any(r[5] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(con.execute(D.SQL["op12_decontamination"]).fetchall(), key=str) == got
