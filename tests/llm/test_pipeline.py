import random

import corpus_pipeline


def test_stages_keep_columns_and_only_what_the_stage_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert now and len(set(now)) == len(now) and set(now) <= before
        before = set(now)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == before and all(r.n_tokens == len(r.ids) for r in out)
    assert [(n, s) for n, s in corpus_pipeline.STAGES][0][0] == "quality rules"


def test_passages_of_over_50_words_go_wherever_they_repeat(spark, sf):
    r = random.Random(4)
    new = lambda n: ["".join(r.choices("abcdefghé", k=r.randint(1, 7))) + str(r.random())[2:5] for _ in range(n)]
    short = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    cases = [(n, f(n)) for n in range(48, 59) for f in (new, short)]
    rows, want = [], {}
    for k, (n, part) in enumerate(cases):
        for copy in range(3):
            before, after, i = new(70), new(60), 10 * k + copy
            rows.append((i, " ".join(before) + "\n" + (" ", "\n", " \t")[copy].join(part) + "\n" + " ".join(after), "en", "s", 1))
            want[i] = before + (part if n <= 50 else []) + after
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema)
    got = {x.doc_id: x for x in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert {i: x.text.split() for i, x in got.items()} == want
    assert all(x.n_chars == len(x.text) for x in got.values())


def test_nulls_repeats_empty_tables_long_texts_and_further_columns(spark, sf):
    r = random.Random(9)
    new = lambda n: " ".join(f"w{r.random()}" for _ in range(n))
    a, b, c, long = new(80), new(80), new(80), new(60_000)
    rows = [(1, a, "en", "s", 5), (1, a, "en", "s", 5), (1, b, None, None, None), (2, a + " x", "en", "s", 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \n", None, "s", 2), (None, c, "en", None, 5), (None, c, "de", "s", 5), (6, long, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'k' as mark", "1 as row", "2 as id", "3 as key", "true as kept")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    stages = dict(corpus_pipeline.STAGES)
    told = lambda name: sorted(((x.doc_id, x.text) for x in stages[name](spark, docs, sf).select("doc_id", "text").collect()), key=str)
    assert told("quality rules") == sorted([(i, t) for i, t, *_ in rows if t and t.strip()], key=str)
    assert told("near duplicates") == sorted([(1, a), (1, b), (3, None), (4, ""), (5, " \n"), (None, c), (6, long)], key=str)
    assert told("repeated passages") == sorted([(2, " x"), (1, b), (6, long), (5, " \n")], key=str)
    mixed = stages["source mix"](spark, docs, sf)
    assert mixed.columns == corpus_pipeline.COLUMNS and {(x.doc_id, x.text) for x in mixed.collect()} <= {(i, t) for i, t, *_ in rows}
    out = stages["bpe"](spark, docs, sf).collect()
    assert len(out) == len(rows) and sorted(x.n_tokens for x in out)[:2] == [0, 0]
