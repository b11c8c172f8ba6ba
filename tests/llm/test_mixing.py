import pytest

from tessera.llm.mixing import budgets, mix_sources


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("c", "x", 5)], "domain string, lang string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in budgets(leaves, ("domain", "lang"), {"domain": {"a": 2.0}}, 0.2, 1).collect()}
    total = 2015 * 0.2
    assert got["c", "x"] == 5 and got["a", "x"] == 10
    assert got["a", "x"] + got["a", "y"] == pytest.approx((total - 5) * 2 / 3) and got["b", "x"] == pytest.approx((total - 5) / 3)


def test_prefixes_epochs_and_odd_rows(spark):
    rows = [(i, "w " * (1 + i % 7), ["en", "de", None][i % 3], f"src{i % 5}", "x") for i in range(300)] + [(900, None, "en", "src1", "y"), (901, "", None, None, "y"), (5, "w", "en", "src0", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget string")
    taken = mix_sources(docs, share=1.0, max_epochs=2)
    assert taken.columns == [*docs.columns, "mix_tokens", "mix_epoch"]
    total = sum(len((r[1] or "").split()) for r in rows)
    got = taken.collect()
    spent = sum(r.mix_tokens for r in got)
    assert total * 0.9 <= spent <= total and {r.mix_epoch for r in got} == {1, 2}
    assert mix_sources(docs, share=1.0, max_epochs=1).count() == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(7), share=1.0, max_epochs=2).collect()))
    assert mix_sources(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mix_sources(docs.withColumnRenamed("budget", "mix_epoch"))
