"""Token counts from flat token files (operator 2), by separator scan.

A flat token file is nothing but token ids of one width, documents ended by a separator
id, without an index. Each file is searched block by block: the places of separators are
found with one vectorised comparison, and a block reports only the documents that end in
it and the tokens left over at its end. Documents that straddle blocks or files are
stitched by a prefix scan over the blocks' summaries: first inside each file, then over
one row a file. Token counts and places in the stream follow, no token is moved.

Defined cases: an empty file has no documents; two separators side by side end an empty
document; tokens after the last separator are a document of their own, marked not ended;
a file whose length is no multiple of the token width is an error; no files give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path
from .text import Rolling, Words, pieces

EOD = 0  # the separator in files that write_tokens makes; word ids are 1 to 65535


def _write_job(batches):
    for batch in batches:
        for i, j, data, offsets in pieces(batch.column("text")):
            words = Words(data, offsets)
            ids = (words.hashes(Rolling(data)) % np.uint64(65535) + np.uint64(1)).astype("<u2").tobytes()
            ends = words.first * 2
            rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(rows, pa.binary())], names=["id", "tokens"])


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Flat files of two-byte word ids (hashed into 65535), documents in order of id (then a hash of the tokens, then the tokens) over the files' names. Null texts are empty."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = given.mapInArrow(_write_job, f"id {given.schema['id'].dataType.simpleString()}, tokens binary")
    # bounds of ranges are sampled on the driver, so they must not hold the tokens themselves
    ranged = tokens.withColumn("mark", F.xxhash64("tokens")).repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "tokens")
    # the text writer puts bytes as they are and its line separator, here the separator id, after each row
    ranged.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", "\x00\x00").text(path)


def _scan_job(width: int, eod: int, block: int):
    kind = np.dtype(f"<u{width}")

    def job(batches):
        for batch in batches:
            for r in range(len(batch)):
                path, raw = batch.column("path")[r].as_py(), batch.column("content")[r].as_buffer()
                if raw.size % width:
                    raise ValueError(f"{path} has {raw.size} bytes, no multiple of {width}")
                tokens = np.frombuffer(raw, kind)
                for number, start in enumerate(range(0, max(len(tokens), 1), block)):
                    part = tokens[start : start + block]
                    ends = np.flatnonzero(part == eod)
                    sizes = np.diff(np.r_[-1, ends]) - 1
                    tail = len(part) - (ends[-1] + 1 if len(ends) else 0)
                    yield pa.RecordBatch.from_pydict({"path": [path], "block": [number], "start": [start], "tokens": [len(part)], "ends": [len(ends)], "tail": [int(tail)], "sizes": [sizes.astype(np.int64)]}, schema=SUMMARY)

    return job


SUMMARY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64()), ("tail", pa.int64()), ("sizes", pa.list_(pa.int64()))])


def token_counts(spark: SparkSession, path: str, width: int = 2, eod: int = EOD, block: int = 1 << 18) -> DataFrame:
    """One row per document of the stream of files in `path`, ordered by name: doc_index and start_token (from 0), n_tokens (without the separator), ended.

    Files are read whole by a task each, so writers roll them; `spark.sql.sources.binaryFile.maxLength` bounds their size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    blocks = files.select("path", "content").mapInArrow(_scan_job(width, eod, block), "path string, block long, start long, tokens long, ends long, tail long, sizes array<long>")
    # tokens that stand open at the start of each block of a file, and of each file
    inside = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("start") + F.col("tokens") - F.col("tail")
    told = blocks.withColumn("cut", F.max(F.when(F.col("ends") > 0, place)).over(inside)).withColumn("before", F.coalesce(F.sum("ends").over(inside), F.lit(0)))
    whole = told.groupBy("path").agg(F.sum("ends").alias("all_ends"), F.sum("tokens").alias("all_tokens"), F.max(F.when(F.col("ends") > 0, place)).alias("last_cut"))
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    file = whole.withColumn("file_start", F.coalesce(F.sum("all_tokens").over(order), F.lit(0))).withColumn("file_docs", F.coalesce(F.sum("all_ends").over(order), F.lit(0)))
    file = file.withColumn("file_cut", F.coalesce(F.max(F.col("file_start") + F.col("last_cut")).over(order), F.lit(0)))
    at = told.join(file.select("path", "file_start", "file_docs", "file_cut"), "path").filter("ends > 0")
    at = at.withColumn("open", F.coalesce(F.col("file_start") + F.col("cut"), F.col("file_cut"))).withColumn("base", F.col("file_start") + F.col("start"))
    # a block's first document began where the stream stood open, the others after the separator before them
    ended = at.select(
        (F.col("file_docs") + F.col("before")).alias("docs"), "open", "base", F.posexplode("sizes").alias("k", "size"), (F.col("file_start") + F.col("start")).alias("from"),
    )
    inner = Window.partitionBy("docs").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.withColumn("start_token", F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("from") + F.sum(F.col("size") + 1).over(inner)))
    ended = ended.withColumn("n_tokens", F.when(F.col("k") == 0, F.col("from") + F.col("size") - F.col("open")).otherwise(F.col("size")))
    rest = file.agg(F.sum("all_tokens").alias("all"), F.sum("all_ends").alias("docs"), F.coalesce(F.max(F.col("file_start") + F.col("last_cut")), F.lit(0)).alias("cut"))
    rest = rest.select(F.col("docs").alias("doc_index"), F.col("cut").alias("start_token"), (F.col("all") - F.col("cut")).alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.select((F.col("docs") + F.col("k")).alias("doc_index"), "start_token", "n_tokens", F.lit(True).alias("ended")).union(rest)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_counts(spark, path)


QUERIES = {"op2_token_counts": op2_token_counts}
SQL = {
    "op2_token_counts": r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, CAST(sum(n + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n - 1 AS BIGINT) AS start_token, n AS n_tokens, true AS ended FROM d""",
}
