"""Benchmark decontamination by suffix arrays of the training texts (operator 12).

Texts are taken as words. Each shard of a task's texts becomes a suffix array, and every
test suffix that is as long as a window or longer is searched in it: an interval of the
array that narrows word by word gives the longest verbatim match and all its places.
Shards end between suffixes and look on into the next one's words, so no match is lost.

A shard's alphabet is the words of the test items; all other words, and ends of texts, are
one symbol that no test suffix holds, so suffixes that begin with it are left out and no
suffix is ordered beyond it or beyond the longest item. Order comes from sorting packed
words once, and then, by doubling, only what is still equal. Words are compared by their bytes.

Test items go to the tasks in blocks of a bounded size, one reading of the texts for each.

Defined cases: a null text has no words, and no hit; items without a word, and null ones, have no
window; items that repeat an id are one item with all their windows; an item without an
id counts, as one, and is not in the list of ids; repeated documents and ids are rows of their own; a text
of any length is taken whole (its words in one task); empty tables give no rows or no
hits; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written
from .text import U, mix, per_row, pieces

WINDOW = 10
BLOCK = 4 << 20  # bytes of test items sent at a time
PIECE = 8 << 20  # bytes of texts taken at a time
SHARD = 1 << 21  # suffixes of one array, at most

#: Bytes of words as they are compared (A-Z lower-cased); 0 for bytes between words.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_ODD = U(0x9E3779B97F4A7C15)


class Tokens:
    """Words of several texts: keys of 8 bytes, equal for equal words, and the bytes in eights."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = np.zeros(len(data) + 8, np.uint8)
        np.take(FOLD, data, out=low[: len(data)])
        ink = low[: len(data) + 1] > 0
        begins = ink.copy()
        begins[1:] &= ~ink[:-1]
        edges = offsets[:-1]
        begins[edges] = ink[edges]
        self.starts = np.flatnonzero(begins)
        stop = np.zeros(len(ink), bool)
        stop[1:] = ink[:-1] & ~ink[1:]
        inner = edges[edges > 0]
        stop[inner] = ink[inner - 1]
        self.lengths = np.flatnonzero(stop) - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.eights = np.ndarray((len(data) + 1,), "<u8", low.data, strides=(1,))
        self.keys = self.eight(np.arange(len(self.starts)), 0)
        k, long = 1, np.flatnonzero(self.lengths > 8)
        while len(long):
            self.keys[long] = mix(self.keys[long] * _ODD + self.eight(long, k))
            k += 1
            long = long[self.lengths[long] > 8 * k]

    def eight(self, words: np.ndarray, k: int) -> np.ndarray:
        return self.eights[self.starts[words] + 8 * k] & _MASK[np.minimum(self.lengths[words] - 8 * k, 8)]


@dataclass
class Tests:
    """A block of test items: its vocabulary and its windows' suffixes."""

    keys: np.ndarray  # of the vocabulary, rising
    lengths: np.ndarray  # in bytes
    eights: list[np.ndarray]  # the vocabulary's bytes
    symbols: np.ndarray  # the items' words, numbered from 1, with a 0 after each item
    suffix: np.ndarray  # where suffixes of a window and more begin
    room: np.ndarray  # words from there to the item's end
    window: np.ndarray
    owner: np.ndarray  # item of each suffix
    names: list = field(default_factory=list)

    @property
    def depth(self) -> int:
        return int(self.room.max(initial=1))

    def numbered(self, words: Tokens) -> np.ndarray:
        """Numbers of words in the vocabulary, from 1; 0 if they are not in it."""
        if not len(self.keys):
            return np.zeros(len(words.keys), np.int32)
        at = np.minimum(np.searchsorted(self.keys, words.keys), len(self.keys) - 1)
        same = (self.keys[at] == words.keys) & (self.lengths[at] == words.lengths)
        k, long = 0, np.flatnonzero(same & (words.lengths > 8))
        while len(long):  # keys of long words are hashes: their bytes decide
            same[long] &= words.eight(long, k) == self.eights[k][at[long]]
            k += 1
            long = long[words.lengths[long] > 8 * k]
        return np.where(same, at + 1, 0).astype(np.int32)


def spread(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a 0 after each text, and where each text begins in them."""
    counts = np.diff(first)
    symbols = np.zeros(len(numbers) + len(counts), np.int32)
    begin = first[:-1] + np.arange(len(counts))
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts)] = numbers
    return symbols, begin


def tests_of(names: list, texts: list[str | None], window: int = WINDOW) -> Tests:
    encoded = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    words = Tokens(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    eights = np.zeros((len(words.keys), -(-int(words.lengths.max(initial=1)) // 8)), U)
    for k in range(eights.shape[1]):
        some = np.flatnonzero(words.lengths > 8 * k)
        eights[some, k] = words.eight(some, k)
    distinct = np.unique(np.c_[words.keys, words.lengths.astype(U), eights], axis=0)
    if len(np.unique(distinct[:, 0])) < len(distinct):
        raise ValueError("two words of the test items have one key")  # 64 bits: not to be expected
    known = sorted(set(names), key=str)
    number = {name: k for k, name in enumerate(known)}
    out = Tests(distinct[:, 0], distinct[:, 1].astype(np.int64), list(distinct[:, 2:].T), *[np.zeros(0, np.int64)] * 5, names=known)
    out.symbols, begin = spread(out.numbered(words), words.first)
    counts = np.diff(words.first)
    least = np.minimum(counts, window)
    searched = np.where(counts > 0, counts - least + 1, 0)
    item = np.repeat(np.arange(len(counts)), searched)
    inside = np.arange(len(item)) - np.repeat(np.cumsum(searched) - searched, searched)
    out.suffix, out.room, out.window = begin[item] + inside, counts[item] - inside, least[item]
    out.owner = np.array([number[n] for n in names], np.int64)[item] if len(item) else np.zeros(0, np.int64)
    return out


class SuffixArray:
    """Suffixes of symbols that begin before `starts` and not with 0, in order through `depth` symbols or their first 0."""

    def __init__(self, symbols: np.ndarray, starts: int, depth: int, top: int):
        """top: the largest symbol that there may be."""
        self.bits = max(1, int(top).bit_length())
        self.packed = max(1, min(62 // self.bits, depth))
        self.symbols = np.r_[symbols, np.zeros(depth + 1, symbols.dtype)]
        at = np.flatnonzero(symbols > 0)
        zero = np.flatnonzero(self.symbols == 0)
        run = zero[np.searchsorted(zero, at)] - at
        key = self.pack(self.symbols, at, run)
        order = np.argsort(key)
        at, run, key = at[order], run[order], key[order]
        rank = np.zeros(len(self.symbols) + depth, np.int64)
        head = np.r_[True, key[1:] != key[:-1]][: len(at)]
        own = np.flatnonzero(head)[np.cumsum(head) - 1] if len(at) else at
        rank[at] = own + 1
        done = self.packed
        while done < depth and len(at):
            many = np.diff(np.r_[np.flatnonzero(head), len(at)])
            open_ = np.flatnonzero((np.repeat(many, many) > 1) & (run >= done))
            if not len(open_):
                break
            pair = rank[at[open_]] << 32 | rank[at[open_] + done]
            by = np.argsort(pair)
            pair = pair[by]
            at[open_], run[open_] = at[open_][by], run[open_][by]
            first = np.r_[True, pair[1:] != pair[:-1]]
            head[open_] = first
            rank[at[open_]] = (open_[first] + 1)[np.cumsum(first) - 1]
            done *= 2
        near = at < starts
        self.at = at if near.all() else at[near]
        self.keys = key if near.all() else self.pack(self.symbols, self.at, run[near])

    def pack(self, symbols: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The first words as one number, zeros from the first 0 on."""
        key = symbols[at].astype(np.int64)
        for j in range(1, self.packed):
            key = key << self.bits | np.where(run > j, symbols[np.minimum(at + j, len(symbols) - 1)], 0)
        return key

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each interval whose suffixes have this symbol at this depth."""
        ends = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while (some := a < b).any():
                middle = (a + b) >> 1
                there = self.symbols[self.at[np.minimum(middle, len(self.at) - 1)] + depth]
                below = (there <= symbol) if right else (there < symbol)
                a, b = np.where(some & below, middle + 1, a), np.where(some & ~below, middle, b)
            ends.append(a)
        return ends[0], ends[1]

    def search(self, tests: Tests) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For rising depths: the depth, and of the test suffixes that match through it their number and interval."""
        which = np.arange(len(tests.suffix))
        known = np.minimum(tests.room, self.packed)
        key = np.zeros(len(which), np.int64)
        for j in range(self.packed):
            key = key << self.bits | np.where(known > j, tests.symbols[np.minimum(tests.suffix + j, len(tests.symbols) - 1)], 0)
        begun = np.minimum(tests.window, self.packed)  # words that all suffixes of an interval share from the start
        free = (self.bits * (self.packed - begun)).astype(np.int64)
        low = key >> free << free
        lo, hi = np.searchsorted(self.keys, low), np.searchsorted(self.keys, low + (np.int64(1) << free) - 1, "right")
        for depth in range(1, tests.depth + 1):
            late = depth > begun[which]
            lo_, hi_ = lo, hi
            if late.any():
                lo_, hi_ = lo.copy(), hi.copy()
                lo_[late], hi_[late] = self.narrowed(lo[late], hi[late], depth - 1, tests.symbols[tests.suffix[which[late]] + depth - 1])
            stay = (hi_ > lo_) & (tests.room[which] >= depth)
            which, lo, hi = which[stay], lo_[stay], hi_[stay]
            if not len(which):
                return
            told = depth >= tests.window[which]
            if told.any():
                yield depth, which[told], lo[told], hi[told]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    counts = hi - lo
    return np.arange(counts.sum()) + np.repeat(lo - (np.cumsum(counts) - counts), counts)


def matched(symbols: np.ndarray, begin: np.ndarray, tests: Tests, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which symbols are hit; pairs of text and item, distinct; and each text's longest match."""
    edges = np.zeros(len(symbols) + 1, np.int64)
    longest = np.zeros(len(begin), np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    text_of = np.zeros(len(symbols), np.int64)
    text_of[begin[1:]] = 1
    text_of = np.cumsum(text_of)
    items = max(len(tests.names), 1)
    for a in range(0, len(symbols), shard):
        array = SuffixArray(symbols[a : a + shard + tests.depth], shard, tests.depth, len(tests.keys))
        for depth, which, lo, hi in array.search(tests):
            # equal windows have one interval
            _, first = np.unique(lo << 32 | hi, return_index=True)
            found = _ranges(lo[first], hi[first])
            longest[text_of[a + array.at[found]]] = np.maximum(longest[text_of[a + array.at[found]]], depth)
            new = tests.window[which] == depth
            if not new.any():
                continue
            _, first, same = np.unique(lo[new] << 32 | hi[new], return_index=True, return_inverse=True)
            low, high = lo[new][first], hi[new][first]
            places = a + array.at[_ranges(low, high)]
            np.add.at(edges, places, 1)
            np.add.at(edges, places + depth, -1)
            # texts of each window, once, by items of each window
            told = np.unique(np.repeat(np.arange(len(low)), high - low) * len(begin) + text_of[places])
            window, text = told // len(begin), told % len(begin)
            owned = np.unique(same * items + tests.owner[which[new]])
            of, owner = owned // items, owned % items
            lo_, hi_ = np.searchsorted(of, window), np.searchsorted(of, window, "right")
            pairs.append(np.unique(np.c_[np.repeat(text, hi_ - lo_), owner[_ranges(lo_, hi_)]], axis=0))
    return np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0), longest, text_of


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
FOUND = "n_words long, hits array<struct<start:long,words:long>>, items array<string>, longest long"


def _pass(tests, keep_text: bool):
    """One block of tests against all texts; hits and items of blocks before are kept."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for i, j, data, offsets in pieces(column, PIECE):
                yield _told(batch.slice(i, j - i), data, offsets, tests.value, keep_text)

    return job


def _told(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tests: Tests, keep_text: bool) -> pa.RecordBatch:
    words = Tokens(data, offsets)
    symbols, begin = spread(tests.numbered(words), words.first)
    hit, pairs, longest, _ = matched(symbols, begin, tests)
    for k, spans in enumerate(rows.column("hits").to_pylist()):
        for s in spans:
            hit[begin[k] + s["start"] : begin[k] + s["start"] + s["words"]] = True
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(begin, starts, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(starts - begin[text]), pa.array(ends - starts)], fields=list(SPANS.value_type))
    hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(begin) + 1)).astype(np.int32)), spans)
    new = np.searchsorted(pairs[:, 0], np.arange(len(begin) + 1))
    names = [tests.names[k] for k in pairs[:, 1]]
    items = [old + names[a:b] for old, a, b in zip(rows.column("items").to_pylist(), new[:-1], new[1:], strict=True)]
    told = {"n_words": pa.array(np.diff(words.first)), "hits": hits, "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(np.maximum(np.asarray(rows.column("longest")), longest))}
    kept = {c: rows.column(c) for c in rows.schema.names if c not in told and (keep_text or c != "text")}
    return pa.RecordBatch.from_pydict(kept | told)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: `id_col`, n_words, hits (array of start and number of words, from 0), n_hit, items (ids with occurring windows), longest (verbatim match, in words); with `carry`, those columns as `row`."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    count = max(1, -(-size // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(count)))
    row = [F.struct(*carry).alias("row")] if carry else []
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,words:long>>").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    for k in range(count):
        rows = items.filter(F.col("block") == k).select("name", "text").collect()  # about `block` bytes
        tests = spark.sparkContext.broadcast(tests_of([r.name for r in rows], [r.text for r in rows], window))
        last = k == count - 1
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in ("id", "row") or (f.name == "text" and not last))
        found = found.mapInArrow(_pass(tests, not last), f"{schema}, {FOUND}")
        found = found if last else written(found)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["words"])
    return found.withColumn("n_hit", n_hit).select(F.col("id").alias(id_col), "n_words", "hits", "n_hit", "items", "longest", *(["row"] if carry else []))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """The documents, as they are, that hold no window of an item."""
    return contamination(docs, benchmark, window, carry=docs.columns, **columns).filter("n_hit = 0").select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op12_decontamination": op12_decontamination}
SQL = {
    "op12_decontamination": r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS said
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM items WHERE len(ws) > 0)),
places AS (
  SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS said
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM words, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
found AS (SELECT rid, p, n, item FROM places JOIN windows USING (n, said)),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY rid),
held AS (SELECT rid, count(DISTINCT coalesce(item, '')) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)""",
}
