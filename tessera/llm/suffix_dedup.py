"""Suffix-array dedup (operator 1): remove every byte under a repeated window.

Depth-limited radix sort, as Spark passes. Suffixes are ordered only through `width`
bytes, most significant digit first; all that is used of the order are its groups of
equal suffixes, which are the repeated windows. Each pass groups by one more digit and
suffixes that are alone in their group leave, so later passes touch repeats only:

1. The first digit of a window is its anchor: the least-hashed `anchor`-byte string
   inside it. Neighbouring windows share it, so a run of them is one row. Anchors that
   occur once leave.
2. The second digit is the run's whole extent. Runs that equal another are repeated as
   they stand; of each such class one run stays to stand for it in the later passes, and
   only where a run with the same anchor differs.
3. The third digit is the extent of each `STEP` windows, counted from the anchor, of the
   runs that are left; classes are treated as in the second pass.
4. The last digit is all `width` bytes of each window that is left.

Several thresholds (a width in bytes or words each) go through the passes together, as
rows of one table. Equal windows have the same anchor at the same place, so no pass parts them. The anchor's
digit is a cheap hash that only brings together; what says that two runs or windows are
equal is a hash of another kind as well (`text.Rolling`, over all their bytes), so bytes go
on two hashes that know nothing of each other. With `by_words`, `width` and `anchor` count words, hashes of words stand in
place of bytes in every pass, and a span runs from its first word's first byte to its
last word's last, whatever white space lies between. Hot groups (copies, common passages) are aggregated before each shuffle
and joined back by equi-joins, whose partitions Spark can split.

Defined cases: null or empty texts and texts shorter than `width` keep all they have;
rows that repeat another (same id too) are texts of their own, so both lose their common
windows; a null id is a value like others (rows are told apart by id and text); texts of any length are taken whole; an empty
table gives no rows; other columns are ignored unless named in `carry`, which returns
them inside the struct `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, removed, written
from .text import Rolling, U, Words, loose, mix, per_row, pieces

NO_ID = -(2**63)
PIECE = 1 << 17  # bytes that are hashed at a time: what fits a core's cache (a longer text is one piece)
STEP = 16  # windows that pass 3 takes together
_PLACE = 24  # bits of a place inside a stretch of text


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Least of every `span` consecutive keys."""
    have = 1
    while 2 * have <= span:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - span + have], keys[span - have :])


def _anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least-hashed of every `span` consecutive grams, in stretches whose places fit `_PLACE` bits."""
    n, stretch = len(grams) - span + 1, (1 << _PLACE) - span + 1
    out = np.zeros(n, np.int64)
    for a in range(0, n, stretch):
        part = grams[a : a + stretch + span - 1]
        least = _least((part >> U(_PLACE) << U(_PLACE)) | np.arange(len(part), dtype=U), span)
        out[a : a + stretch] = a + (least & U((1 << _PLACE) - 1)).astype(np.int64)
    return out


def _extent(rolling: Rolling, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A digit for all bytes under windows lo to hi and for where their anchor lies."""
    shape = (at - lo).astype(U) * U(1 << 20) + (hi - lo).astype(U)
    return mix(rolling(lo, hi + width) ^ mix(shape)).view(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int, keys_only: bool = False, rolling: Rolling | None = None) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, first and last window, digits 1 and 2; or digit 1 alone. rolling: of data, if it is there already."""
    empty = {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi", "at", "key", "full")}
    if len(data) < width:
        return empty
    grams = loose(data, anchor)
    anchors = _anchors(grams, width - anchor + 1)
    whole = np.zeros(len(data) + 1, np.int64)  # does a window that begins here end inside its text?
    fits = np.diff(offsets) >= width
    np.add.at(whole, offsets[:-1][fits], 1)
    np.add.at(whole, offsets[1:][fits] - width + 1, -1)
    whole = np.cumsum(whole)[: len(anchors)] > 0
    first = np.r_[True, anchors[1:] != anchors[:-1]]
    first[offsets[:-1][fits]] = True
    lo = np.flatnonzero(first & whole)
    if not len(lo):
        return empty
    mark = anchors[lo]
    if keys_only:
        return empty | {"key": grams[mark].view(np.int64)}
    text = np.searchsorted(offsets, lo, "right") - 1
    hi = np.minimum(np.r_[lo[1:], len(anchors)], offsets[text + 1] - width + 1) - 1
    start = offsets[text]
    return {"text": text, "lo": lo - start, "hi": hi - start, "at": mark - start, "key": grams[mark].view(np.int64), "full": _extent(rolling or Rolling(data), lo, hi, mark, width)}


def _given(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None) -> DataFrame:
    """Columns k (id, none null), text, mark (which tells texts of one id apart), row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), text.alias("text"), F.xxhash64(text).alias("mark"), *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []))


def _pack_job(carry: bool):
    """Texts compressed one by one, for the shuffles."""

    def job(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                whole = data.tobytes()
                packed = [codec.compress(whole[a:b], asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                names = ["k", *(["row"] if carry else []), "mark", "size", "packed"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names[: 2 + carry]), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], names=names)

    return job


def _unpacked(batch: pa.RecordBatch, limit: int = PIECE):
    """As pieces(), from the columns size and packed."""
    codec, sizes, packed = pa.Codec("zstd"), np.asarray(batch.column("size")), batch.column("packed")
    ends = np.r_[0, np.cumsum(sizes)]
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        whole = b"".join(codec.decompress(packed[x].as_py(), int(sizes[x]), asbytes=True) for x in range(i, j))
        yield i, j, np.frombuffer(whole, np.uint8), ends[i : j + 1] - ends[i]
        i = j


def _units(data: np.ndarray, offsets: np.ndarray, by_words: bool, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """What windows are made of, and where each text's begin: bytes, or hashes of words. rolling: of data."""
    if not by_words:
        return data, offsets
    words = Words(data, offsets)
    return words.hashes(rolling), words.first


Threshold = tuple[int, int, bool]  # width, anchor, by words


def _mixed(key: np.ndarray, *numbers) -> np.ndarray:
    out = key.view(U)
    for x in numbers:
        out = mix(out ^ mix(np.asarray(x).astype(U) + U(1)))
    return out.view(np.int64)


def _batch(batch: pa.RecordBatch, rows: np.ndarray, number: int, named: dict[str, np.ndarray]) -> pa.RecordBatch:
    take = pa.array(rows)
    kind = {"lo": pa.int32(), "hi": pa.int32(), "at": pa.int32(), "p": pa.int32()}
    return pa.RecordBatch.from_arrays([batch.column("k").take(take), batch.column("mark").take(take), pa.array(np.full(len(rows), number, np.int32)), *(pa.array(v, kind.get(n, pa.int64())) for n, v in named.items())], names=["k", "mark", "t", *named])


def _run_job(thresholds: list[Threshold], keys_only: bool):
    """Passes 1 and 2; t: the number of the threshold."""

    def job(batches):
        for batch in batches:
            for i, _, data, offsets in pieces(batch.column("text"), PIECE):
                rolling = Rolling(data)  # one for all thresholds
                for t, (width, anchor, by_words) in enumerate(thresholds):
                    out = runs(*_units(data, offsets, by_words, rolling), width, anchor, keys_only, None if by_words else rolling)
                    out["key"] = _mixed(out["key"], t)
                    yield pa.RecordBatch.from_arrays([pa.array(out["key"])], names=["key"]) if keys_only else _batch(batch, out.pop("text") + i, t, out)

    return job


def _per_text(batch: pa.RecordBatch, i: int, j: int, column: str) -> tuple[np.ndarray, ...]:
    """The lists of structs (lo, hi, ...) of rows [i, j): row, lo, hi, ..."""
    lists = batch.column(column).slice(i, j - i)
    flat = lists.flatten()
    row = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0)))
    return row, *(np.asarray(flat.field(k)).astype(np.int64) for k in range(flat.type.num_fields))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _parts(thresholds: list[Threshold]):
    """From batches of texts: pieces with their first row, and by threshold its number, width, hash of units, where texts begin, and row, lo, hi, at, key of its parts."""

    def each(batch):
        for i, j, data, offsets in _unpacked(batch):
            row, t, *rest = _per_text(batch, i, j, "parts")
            rolling = Rolling(data)
            for k, (width, _, by_words) in enumerate(thresholds):
                if (own := t == k).any():
                    units, begins = _units(data, offsets, by_words, rolling)
                    yield i, k, width, Rolling(units) if by_words else rolling, begins, row[own], *(x[own] for x in rest)

    return each


def _step_job(thresholds: list[Threshold]):
    """Pass 3: the windows of each part, `STEP` at a time by their distance from the anchor."""

    def job(batches):
        for batch in batches:
            for i, k, width, rolling, offsets, row, lo, hi, at, key in _parts(thresholds)(batch):
                top = (at - lo) // STEP
                count = top - (at - hi) // STEP + 1
                lo, hi, at, key, row, top = (np.repeat(x, count) for x in (lo, hi, at, key, row, top))
                which = top - _within(count)
                first, last = np.maximum(lo, at - which * STEP - STEP + 1), np.minimum(hi, at - which * STEP)
                full = _extent(rolling, offsets[row] + first, offsets[row] + last, offsets[row] + at, width)
                yield _batch(batch, row + i, k, {"lo": first, "hi": last, "at": at, "key": _mixed(key, which + (1 << 40)), "full": full})

    return job


def _window_job(thresholds: list[Threshold]):
    """Pass 4: the windows of each part, one by one."""

    def job(batches):
        for batch in batches:
            for i, k, width, rolling, offsets, row, lo, hi, at, key in _parts(thresholds)(batch):
                count = hi - lo + 1
                row, at, key, p = np.repeat(row, count), np.repeat(at, count), np.repeat(key, count), np.repeat(lo, count) + _within(count)
                digit = rolling(offsets[row] + p, offsets[row] + p + width)
                yield _batch(batch, row + i, k, {"p": p, "key": _mixed(key, at - p), "digit": digit.view(np.int64)})

    return job


_RUN = "k long, mark long, t int, lo int, hi int, at int, key long, full long"


def _told(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Of runs with digits key and full: those that equal another, and by text those that the next pass has to part."""
    place = F.xxhash64("k", "mark", "t", "lo")  # should two agree, both stand for their class; a number needs no sort
    classes = rows.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(place).alias("stands"))
    digits = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    known = classes.join(digits.filter("kinds > 1 or least > 1"), "key")
    more = (F.col("kinds") > 1) & ((F.col("n") == 1) | ((F.col("stands") == place) & (F.col("least") == 1)))
    told = written(rows.join(known, ["key", "full"]).select("k", "mark", "t", "lo", "hi", "at", "key", "n", more.alias("more")).filter("n >= 2 or more"), path)
    return told.filter("n >= 2"), told.filter("more").groupBy("k", "mark").agg(F.collect_set(F.struct("t", "lo", "hi", "at", "key")).alias("parts"))


def repeated_windows(given: DataFrame, texts: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """By text (k, mark) the spans, an array of (t, lo, hi), of bytes or words under windows that occur again; t: the number of the threshold."""
    texts = texts.select("k", "mark", "size", "packed")
    keys = given.select("text").mapInArrow(_run_job(thresholds, True), "key long")
    rows = given.select("k", "mark", "text").mapInArrow(_run_job(thresholds, False), _RUN)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2").select("key")
    spark = given.sparkSession
    paths = [new_path(spark) for _ in range(7)]  # each table goes as soon as no later step reads it
    shared = written(shared, paths[0])  # the join's sides are then plain exchanges, which Spark splits where a key is hot
    found, parts = _told(written(rows.join(shared, "key"), paths[1]), paths[2])
    removed(spark, *paths[:2])
    closer, parts = _told(written(texts.join(parts, ["k", "mark"]).mapInArrow(_step_job(thresholds), _RUN), paths[3]), paths[4])
    removed(spark, paths[3])
    windows = written(texts.join(parts, ["k", "mark"]).mapInArrow(_window_job(thresholds), "k long, mark long, t int, p int, key long, digit long"), paths[5])
    again = windows.groupBy("key", "digit").agg(F.count("*").alias("n")).filter("n >= 2").select("key", "digit")
    one = written(windows.join(again, ["key", "digit"]).select("k", "mark", "t", F.col("p").alias("lo"), F.col("p").alias("hi")), paths[6])
    removed(spark, paths[5])
    spans = found.union(closer).select("k", "mark", "t", "lo", "hi").union(one)
    spans = spans.withColumn("hi", F.col("hi") + F.get(F.array(*[F.lit(w) for w, _, _ in thresholds]), F.col("t")))
    out = written(spans.groupBy("k", "mark").agg(F.collect_set(F.struct("t", "lo", "hi")).alias("spans")))
    removed(spark, paths[2], paths[4], paths[6])
    return out


def _under(found: tuple, number: int, data: np.ndarray, offsets: np.ndarray, by_words: bool) -> np.ndarray:
    """Which bytes lie under the spans (row, t, lo, hi) of a threshold."""
    row, lo, hi = (x[found[1] == number] for x in (found[0], *found[2:]))
    if by_words and len(row):
        words = Words(data, offsets)
        lo, hi = words.starts[words.first[row] + lo] - offsets[row], words.ends[words.first[row] + hi - 1] - offsets[row]
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, offsets[row] + lo, 1)
    np.add.at(change, offsets[row] + hi, -1)
    return np.cumsum(change)[:-1] > 0


def _cut_job(carry: bool, by_words: bool, passages: bool):
    def job(batches):
        for batch in batches:
            for i, j, data, offsets in _unpacked(batch):
                found = _per_text(batch, i, j, "spans")
                gone = _under(found, 0, data, offsets, by_words)
                before = np.r_[False, gone[:-1]] if len(gone) else gone
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                start, kept = gone & ~before, ~gone
                sums = np.r_[0, np.cumsum(kept)][offsets]
                stay = data[kept]
                body = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(sums.astype(np.int32)), pa.py_buffer(stay.tobytes())])
                begins = np.flatnonzero(start)
                after = np.r_[gone[1:], False] if len(gone) else gone
                after[offsets[1:][offsets[1:] > 0] - 1] = False
                stops = np.flatnonzero(gone & ~after) + 1
                own = np.searchsorted(offsets, begins, "right") - 1
                counts = np.bincount(own, minlength=j - i)
                flat = pa.StructArray.from_arrays([pa.array(begins - offsets[own]), pa.array(stops - offsets[own])], names=["lo", "hi"])
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)
                size = np.diff(offsets)
                names = ["k", *(["row"] if carry else []), "n_bytes", "n_removed", "spans", "kept"]
                columns = [*(batch.column(c).slice(i, j - i) for c in names[: 1 + carry]), pa.array(size), pa.array(size - np.diff(sums)), spans, body]
                if passages:
                    names.append("passage_bytes")
                    columns.append(pa.array(per_row(_under(found, 1, data, offsets, True), offsets)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return job


def suffix_dedup(docs: DataFrame, width: int = 400, anchor: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, by_words: bool = False, passage: int | None = None) -> DataFrame:
    """One row per text: `id_col`, n_bytes, n_removed, spans (removed runs, as array of lo, hi), kept (bytes that stay), and `row` if `carry` names columns.

    With `passage`, also passage_bytes: bytes under windows of so many words that occur again; they stay.
    """
    if not 0 < anchor < width or width > 1 << 19 or not (passage is None or passage > 1):
        raise ValueError("0 < anchor < width <= 2**19 and passage > 1 are needed")
    given = _given(docs, id_col, text_col, carry)
    row = f"row {given.schema['row'].dataType.simpleString()}, " if carry else ""
    texts = given.mapInArrow(_pack_job(bool(carry)), f"k long, {row}mark long, size long, packed binary")
    thresholds = [(width, anchor, by_words), *([(passage, passage // 2, True)] if passage else [])]
    spans = repeated_windows(given, texts, thresholds)
    out = texts.join(spans, ["k", "mark"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<t:int,lo:int,hi:int>>")))
    more = ", passage_bytes long" if passage else ""
    cut = out.mapInArrow(_cut_job(bool(carry), by_words, bool(passage)), f"k long, {row}n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary{more}")
    return cut.withColumn("k", F.when(F.col("k") != NO_ID, F.col("k"))).withColumnRenamed("k", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what is cut at 400 bytes, and the bytes under passages of over 50 words, many of which are shorter."""
    cut = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=51)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_bytes")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
