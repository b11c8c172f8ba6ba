import random

from tessera.llm.bpe import bpe_decode, bpe_encode, byte_bpe_path

ODD = [" ", " ", "\u0085", " ", " ", " ", " ", "\x1c", "　", "é", "ß", "日本", "👍🏽", "'s", "'ll", "<|endoftext|>", "<|endof", "  ", "\n", "\t", "\r\n", "12", "x", "Hello", "!!", "`", "\x00", "é"]


def test_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(400)]
    texts += ["", None, "a" * 30_000, " " * 5000, "<|endoftext|>", "plain words and tionnd éieraux ", texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe_encode(docs, byte_bpe_path(), carry=["ids"])
    got = {x.doc_id: list(x.ids) for x in encoded.collect()}
    back = {x.doc_id: x.text for x in bpe_decode(encoded.drop("row"), byte_bpe_path()).collect()}
    t = Tokenizer.from_file(byte_bpe_path())
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == want, repr(text)
        assert back[i] == t.decode(want, skip_special_tokens=False)
    assert bpe_encode(docs.limit(0), byte_bpe_path()).collect() == []


def test_equals_the_library_on_documents(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = Tokenizer.from_file(byte_bpe_path())
    rows = docs.collect()
    want = {d.doc_id: e.ids for d, e in zip(rows, t.encode_batch([d.text for d in rows], add_special_tokens=False), strict=True)}
    assert {x.doc_id: list(x.ids) for x in bpe_encode(docs, byte_bpe_path()).collect()} == want
