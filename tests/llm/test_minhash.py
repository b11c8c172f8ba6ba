import random

import numpy as np

from tessera.llm import minhash as m
from tessera.llm.minhash import minhash_classes, op4_minhash, signatures


def brute(rows, least=0.8, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdef", k=4))
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (1005, "two one")]
    for family in range(12):
        base = [word() for _ in range(r.choice([20, 80, 300]))]
        for copy in range(r.choice([1, 2, 5, 20])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = word()
            rows.append((family * 50 + copy, " ".join(text)))
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class_id int")
    got = {x.doc_id: x.class_id for x in minhash_classes(docs).collect()}
    assert got == brute(rows)
    assert minhash_classes(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, ((x.doc_id, x.class_id, x.kept) for x in minhash_classes(twice).collect()))) == sorted(map(str, [(7, 7, True), (7, 7, True), (None, 7, False), (9, 7, False)]))


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    keys = r.integers(1, 2**63, 400).astype(np.uint64)
    x, y = r.uniform(0.1, 9, 400), r.uniform(0.1, 9, 400)
    sig = signatures(np.r_[keys, keys], np.r_[x, y], np.array([0, 400, 800]), 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_rows_of_one_id_with_different_texts_are_their_own(spark):
    r = random.Random(4)
    a, b = ([f"w{r.random()}" for _ in range(100)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(["x", *a[1:]])), (3, " ".join(["y", *b[1:]])), (4, None), (None, " ".join([*a[:99], "z"]))]
    for order in (rows, rows[::-1]):
        got = minhash_classes(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(map(str, ((x.doc_id, x.class_id, x.kept) for x in got))) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, 1, False)]))


def test_a_large_family_around_the_threshold(spark, monkeypatch):
    """2,000 members of which few are near their hub: every class of brute force, in blocks."""
    monkeypatch.setattr(m, "BLOCK", 100)
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklm", k=6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(2000):
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3, 3, 3])):
            text[r.randrange(len(text))] = word()
        rows.append((i, " ".join(text[r.randrange(3) :])))
    got = {x.doc_id: x.class_id for x in minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_matrix(rows)
    far = []
    for i in range(400):  # all pairs just under the threshold
        text = list(base)
        for k in r.sample(range(0, 115, 5), 2) if i else []:
            text[k : k + 2] = [word(), word()]
        far.append((i, " ".join(text)))
    got = {x.doc_id: x.class_id for x in minhash_classes(spark.createDataFrame(far, "doc_id long, text string")).collect()}
    assert got == by_matrix(far)


def by_matrix(rows, least=0.8, size=5):
    """Classes by all pairs at once."""
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for _, t in rows)]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    own = np.zeros((len(rows), len(number)), np.float32)
    for k, s in enumerate(sets):
        own[k, [number[x] for x in s]] = 1
    both, n = own @ own.T, own.sum(1)
    near = both >= least * (n[:, None] + n[None, :] - both) - 1e-4
    label = np.arange(len(rows))
    while True:
        now = np.where(near, label[None, :], len(rows)).min(1)
        if (now == label).all():
            return {rows[k][0]: rows[int(x)][0] for k, x in enumerate(label)}
        label = now


def test_recall_of_all_true_pairs_of_a_table(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((d.text or "").split()) >= 5]
    want = by_matrix(docs)
    got = {x.doc_id: x.class_id for x in op4_minhash(spark, sf).collect()}
    assert {i: got[i] for i in want} == want
