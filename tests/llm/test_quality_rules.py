import random
import re
from collections import Counter

from tessera.llm.quality_rules import op8_quality_rules, quality_rules


def brute(text, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, lines = len(w), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    often = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    twice = {i + k for i in range(n - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
    longest, covered = 0, set()
    for i in range(n):
        for j in range(i):
            same = 0
            while i + same < n and w[i + same] == w[j + same]:
                same += 1
            longest = max(longest, same)
            if same >= least:
                covered |= set(range(i, i + same)) | set(range(j, j + same))
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(covered), longest


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choices(["a ", "b ", "cé ", "\n", "d# ", " ", "ab"], k=r.randint(0, 80))) for _ in range(200)]
    texts += ["", None, "\n", "a\n\na", "x\nx", " \t\n", "word " * 300, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {x.doc_id: x for x in quality_rules(docs, 4, 0.3, 10, carry=["kept"]).collect()}
    for i, t in enumerate(texts):
        x, want = got[i], brute(t or "", 4)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.covered_words, x.longest_repeat) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert x.base_failed == failed and x.kept == (not failed and want[5] <= 0.3 * want[0] and want[6] <= 10) and x.row.kept
    assert quality_rules(docs.limit(0)).collect() == []


def test_covered_share_alone_rejects_with_the_query_parameters(spark, tmp_path):
    r = random.Random(2)
    new = lambda n: [f"w{r.random()}" for _ in range(n)]
    part = new(40)
    texts = [[*new(60), *part, *new(60), *part, *new(60), *part, *new(60), *part], [*new(60), *part, *new(260), *part], new(400)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op8_quality_rules(spark, str(tmp_path)).collect()}
    assert [(got[i].n_words, got[i].covered_words, got[i].longest_repeat) for i in range(3)] == [(400, 160, 40), (400, 80, 40), (400, 0, 0)]
    assert not any(x.base_failed for x in got.values()) and [got[i].kept for i in range(3)] == [False, True, True]


def test_lines_that_collide_in_polynomials_modulo_a_power_of_two(spark):
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, t + "\n" + t.translate(str.maketrans("ab", "ba"))), (2, t + "\n" + t)], "doc_id long, text string")
    assert {x.doc_id: (x.n_dup_lines, x.longest_repeat) for x in quality_rules(docs).collect()} == {1: (0, 0), 2: (1, 1)}
