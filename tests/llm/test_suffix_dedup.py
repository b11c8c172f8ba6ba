import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import suffix_dedup as module
from tessera.llm import text
from tessera.llm.suffix_dedup import suffix_dedup


def brute(rows, width):
    """Every window by itself."""
    seen = Counter(b[i : i + width] for b in rows for i in range(len(b) - width + 1))
    for b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def check(spark, texts, width, anchor):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, k int")
    got = {r.doc_id: r for r in suffix_dedup(docs, width, anchor, carry=["spans", "k"]).collect()}
    want = list(brute([(t or "").encode() for t in texts], width))
    for i, (n, removed, runs, digest) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (n, removed, runs, digest), i
        assert sum(s.hi - s.lo for s in r.spans) == removed and r.row.k == 1


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["ab", "çd ", "xyz ", "q", "\n", "lorem "]
    shared = ["".join(r.choices(words, k=60)) for _ in range(6)]
    texts = [None, "", "ab", "a" * 50, "a" * 19, "b" * 20]
    for _ in range(80):
        texts.append("".join(r.choice(shared)[: r.randint(5, 150)] if r.random() < 0.3 else "".join(r.choices(words, k=r.randint(1, 40))) for _ in range(r.randint(0, 6))))
    texts += texts[20:30]
    check(spark, texts, 20, 7)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=60))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + "!"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup(docs, 30, 9).collect())
    assert got == [("1", 60, 60), ("1", 60, 60), ("None", 0, 0), ("None", 61, 60)]
    assert suffix_dedup(docs.limit(0), 30, 9).collect() == []


def test_by_words_against_brute_force(spark):
    r = random.Random(5)
    shared = [r.choices("abcdé", k=30) for _ in range(4)]
    texts = [None, "", " ", "a", "a " * 40]
    for _ in range(60):
        texts.append("".join(w + r.choice([" ", "\n", "  "]) for _ in range(r.randint(0, 5)) for w in (r.choice(shared)[: r.randint(3, 30)] if r.random() < 0.4 else r.choices("abcdefghij", k=r.randint(1, 20)))))
    docs = spark.createDataFrame(list(enumerate([*texts, texts[9]])), "doc_id long, text string")
    got = {x.doc_id: bytes(x.kept).decode().split() for x in suffix_dedup(docs, 8, 3, by_words=True).collect()}
    rows = [(t or "").split() for t in [*texts, texts[9]]]
    seen = Counter(tuple(w[i : i + 8]) for w in rows for i in range(len(w) - 7))
    for k, w in enumerate(rows):
        gone = {i + x for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for x in range(8)}
        assert got[k] == [x for i, x in enumerate(w) if i not in gone], k


def test_texts_longer_than_a_place_s_bits(monkeypatch):
    monkeypatch.setattr(module, "_PLACE", 6)
    r = random.Random(6)
    shared = bytes(r.choices(b"abcd", k=150))
    texts = [bytes(r.choices(b"abcd", k=n)) + shared + bytes(r.choices(b"abcd", k=40)) for n in (0, 61, 700)] + [b"ab", b"a" * 300]
    offsets = np.cumsum([0, *map(len, texts)])
    out, data = module.runs(np.frombuffer(b"".join(texts), np.uint8), offsets, 20, 7), b"".join(texts)
    grams = module.loose(np.frombuffer(data, np.uint8), 7) >> np.uint64(6)
    windows, at = {}, 0
    for text, lo, hi, mark, key in zip(*(out[k].tolist() for k in ("text", "lo", "hi", "at", "key"))):
        for p in range(lo, hi + 1):
            place = int(offsets[text]) + p
            assert mark - p == int(grams[place : place + 14].argmin())  # the first of the least
            assert windows.setdefault(data[place : place + 20], (mark - p, key)) == (mark - p, key)
            at += 1
    assert at == sum(max(0, len(t) - 19) for t in texts)


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


def test_strings_that_collide_in_polynomials_modulo_a_power_of_two(spark):
    t = thue_morse(2048)
    other = t.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, t), (2, other)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in suffix_dedup(docs, 2048, 1024).collect()} == {1: 0, 2: 0}
    check(spark, [t, other, t[:700]], 400, 200)


def test_query_width_and_passages(spark, tmp_path):
    """The query's own parameters against brute force, over shared parts around 400 bytes and 51 words."""
    r = random.Random(8)
    new = lambda n: "".join(r.choices("abcdefgh  ", k=n))
    words = lambda n: " ".join("".join(r.choices("abcd", k=3)) + str(r.random())[2:4] for _ in range(n))
    texts = [None, ""]
    for n in (398, 399, 400, 401, 900):
        part = new(n - 2)
        texts += ["<" + new(300) + "{" + part + "}" + new(200), new(50) + "{" + part + "}é" + new(10)]
    for n in (50, 51, 55):
        part = words(n)
        texts += [words(40) + "\n" + part + "\n" + words(20), words(9) + " " + part + "  " + words(80)]
    spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, k int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in module.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    rows = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in rows for i in range(len(w) - 50))
    for i, w in enumerate(rows):
        assert (got[i].passage_bytes > 0) == any(seen[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50)), i
    assert [got[i].passage_bytes > 0 for i in range(12, 18)] == [False, False, True, True, True, True]


def test_a_text_of_20_mib_is_taken_whole(spark):
    r = np.random.default_rng(2)
    part = bytes(r.integers(97, 123, 1000, np.uint8)).decode()
    long = bytes(r.integers(97, 123, 20 << 20, np.uint8)).decode()
    docs = spark.createDataFrame([(1, long + part), (2, part)], "doc_id long, text string")
    assert {x.doc_id: (x.n_removed, [tuple(s) for s in x.spans]) for x in suffix_dedup(docs).select("doc_id", "n_removed", "spans").collect()} == {1: (1000, [(20 << 20, (20 << 20) + 1000)]), 2: (1000, [(0, 1000)])}


def test_powers_are_kept_while_pieces_of_bytes_and_words_take_turns():
    sizes = [(base, n) for n in (300_000, 20_000, 120_000) for base in (*text._BASES, *(pow(b, -1, text._PRIME) for b in text._BASES))]
    for turn in range(2):
        now = [text.powers(base, n) for base, n in sizes]
        assert all(x.tolist()[-1] == pow(base, n - 1, text._PRIME) for x, (base, n) in zip(now, sizes))
        assert not turn or all(np.shares_memory(a, b) for a, b in zip(before, now))
        before = now
    long = text.powers(text._BASES[0], text._KEEP + 1)  # as a very long text has them: they go with it
    assert not np.shares_memory(long, text.powers(text._BASES[0], 9))


def test_bytes_are_hashed_once_for_all_thresholds(monkeypatch):
    made, own = [], text.Rolling
    monkeypatch.setattr(module, "Rolling", lambda values: made.append(values.dtype) or own(values))
    batch = pa.RecordBatch.from_pydict({"k": [1, 2], "mark": [3, 4], "text": ["a passage of some words " * 9, "and one more " * 20]})
    rows = list(module._run_job([(40, 20, False), (6, 3, True)], False)(iter([batch])))
    assert len(rows) == 2 and [str(x) for x in made] == ["uint8", "uint64"]


def test_least_of_every_span():
    keys = np.random.default_rng(7).integers(0, 2**63, 300).astype(np.uint64)
    for span in (1, 2, 3, 26, 64, 201, 300):
        assert module._least(keys, span).tolist() == [min(keys[i : i + span]) for i in range(301 - span)]
