import numpy as np
import pytest

from tessera.llm.token_counts import token_counts, write_tokens


def brute(tokens, eod):
    ends = [i for i, t in enumerate(tokens) if t == eod]
    out, at = [], 0
    for k, e in enumerate(ends):
        out.append((k, at, e - at, True))
        at = e + 1
    return out + ([(len(ends), at, len(tokens) - at, False)] if at < len(tokens) else [])


@pytest.mark.parametrize("seed", range(3))
def test_stitching_over_blocks_and_files(spark, tmp_path, seed):
    r = np.random.default_rng(seed)
    stream = []
    for k in range(5):
        part = r.integers(0, [3, 12, 2, 40, 9][k], size=r.integers(0, 60)).astype("<u2") if k != 3 else np.ones(20, "<u2")
        (tmp_path / f"part-{k:05d}").write_bytes(part.tobytes())
        stream += part.tolist()
    got = sorted(tuple(x) for x in token_counts(spark, str(tmp_path), block=7).collect())
    assert got == brute(stream, 0)


def test_odd_rows_and_bad_files(spark, tmp_path):
    docs = spark.createDataFrame([(3, "a b c"), (1, None), (2, " \n"), (2, " \n"), (9, "x " * 5000)], "doc_id long, tokens string")
    write_tokens(docs, str(tmp_path / "t"), text_col="tokens")
    assert [(x.doc_index, x.n_tokens, x.ended) for x in token_counts(spark, str(tmp_path / "t")).orderBy("doc_index").collect()] == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 3, True), (4, 5000, True)]
    (tmp_path / "part-1").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_counts(spark, str(tmp_path)).collect()
