import json

from pyspark.sql import functions as F

from tessera.llm.chat import canonical_turns, format_chat, read_chat, read_loss


def test_layouts_and_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_start|>x", "a\nb", "", "\\", "<", "|<||", "<|im_end|>\n<|im_start|>user\n", "é👍"]
    records = [(1, json.dumps({"messages": [{"role": "user", "content": t} for t in odd]})), (2, json.dumps({"prompt": "[1]", "completion": '{"a": 1}'})),
               (3, json.dumps({"conversations": [{"from": "assistant", "value": t} for t in odd]})), (4, json.dumps({"instruction": "i", "input": "n", "output": "o"})),
               (5, json.dumps({"other": 1})), (6, None), (7, "no json"), (8, json.dumps({"messages": [{"role": "r\\s\n<x", "content": None}]})), (9, json.dumps({"messages": []}))]
    turns = canonical_turns(spark.createDataFrame([(i, r, 1) for i, r in records], "conv_id long, record string, layout int"))
    got = {}
    for r in turns.orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert [t for _, _, t in got[1]] == odd and [t for _, _, t in got[3]] == odd
    assert got[2] == [("prompt", "user", "[1]"), ("prompt", "assistant", '{"a": 1}')]
    assert [r for _, r, _ in got[4]] == ["system", "user", "assistant"]
    assert got[5] == got[6] == got[7] == [(None, None, None)] and got[8] == [("messages", "r\\s\n<x", "")]
    out = format_chat(turns).withColumn("back", read_chat(F.col("formatted"))).withColumn("learned", read_loss(F.col("formatted"), F.col("loss")))
    rows = {r.conv_id: r for r in out.collect()}
    for i in (1, 2, 3, 4, 8):
        assert [(t.role, t.text) for t in rows[i].back] == [(r, t) for _, r, t in got[i]]
    assert rows[3].learned == "".join(odd) and rows[1].learned == "" and rows[6].formatted == ""
    assert canonical_turns(spark.createDataFrame([], "conv_id long, record string")).collect() == []


def test_texts_beyond_the_parser_s_limit_keep_their_turns(spark):
    long = 'a\\"b{\\n'  # in JSON: an escaped quote, a bracket and a newline
    row = spark.range(1).select(F.lit(1).alias("conv_id"), F.concat(F.lit('{"prompt": "q: \\"x\\"", "completion" : "'), F.repeat(F.lit(long), 4_000_000), F.lit('"}')).alias("record"))
    got = canonical_turns(row).select("layout", "turn", "role", F.length("text").alias("n"), F.substr("text", F.lit(1), F.lit(5)).alias("begin")).orderBy("turn").collect()
    assert [tuple(x) for x in got] == [("prompt", 0, "user", 6, 'q: "x'), ("prompt", 1, "assistant", 20_000_000, 'a"b{\n')]
    many = spark.range(1).select(F.lit(1).alias("conv_id"), F.concat(F.lit('{"prompt": "q", "completion": "'), F.repeat(F.lit(long), 4_100_000), F.lit('"}')).alias("record"))
    assert canonical_turns(many).select(F.length("text")).collect()[1][0] == 20_500_000
