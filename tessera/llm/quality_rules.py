"""Quality rules with suffix-array repetition (operator 8).

Every text gets the counts of the base rules and a suffix array over its words. The
longest-common-prefix intervals of that array are the repeated word sequences; the
deepest interval over each suffix gives the longest repeat that begins there. Spans of
repeats of `min_repeat` words or more are united; a text is rejected if they cover more
than `max_covered` of its words or if one repeat is longer than `max_repeat` words.
Each word of such a span lies in a 3-word window found twice, so the base rule already
rejects texts with spans over half: `max_covered` acts below 0.5 only.

Defined cases: a null or empty text, or one of white space, has no words and fails the
base rules; equal rows get equal results, each its own row; very long texts are taken
whole (memory follows the largest text); an empty table gives no rows; other columns
are ignored unless named in `carry`, which returns them inside the struct `row`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Rolling, U, Words, mix, per_row, pieces

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def suffix_array(words: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order, and each one's place, by prefix doubling.

    words: one number a word; doc: its text; last: the end of its text. Suffixes end
    with their text. Only suffixes that are still tied are sorted again.
    """
    n = len(words)
    order = np.argsort(mix(words + mix(doc.astype(U) + U(1))), kind="stable")
    keys = mix(words + mix(doc.astype(U) + U(1)))[order]
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank[order] = np.repeat(starts, sizes)
    active = order[np.repeat(sizes > 1, sizes)]
    depth = 1
    while len(active):
        ahead = active + depth
        inside = ahead < last[active]
        follow = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        group = rank[active]
        by = np.lexsort((follow, group))
        active, group, follow = active[by], group[by], follow[by]
        whole = np.r_[True, group[1:] != group[:-1]]
        part = whole | np.r_[True, follow[1:] != follow[:-1]]
        begin = np.flatnonzero(part)
        size = np.diff(np.r_[begin, len(active)])
        first = np.repeat(np.flatnonzero(whole), np.diff(np.r_[np.flatnonzero(whole), len(active)]))
        rank[active] = group + np.repeat(begin, size) - first
        active = active[np.repeat(size > 1, size)]
        depth *= 2
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(rolling: Rolling, order: np.ndarray, doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    a, b = order[:-1], order[1:]
    at = np.flatnonzero(doc[a] == doc[b])
    a, b = a[at], b[at]
    most = np.minimum(last[a] - a, last[b] - b)
    found = np.zeros(len(a), np.int64)
    # widths double while they match (most neighbours differ within a few words), then halve
    live = np.arange(len(a))
    width = 1
    while len(live):
        fits = found[live] + width <= most[live]
        x, y = a[live] + found[live], b[live] + found[live]
        top = np.where(fits, width, 0)
        same = fits & (rolling.raw(x, x + top) == rolling.raw(y, y + top))
        found[live[same]] += width
        live = live[same]
        width *= 2
    while width > 1:
        width //= 2
        fits = found + width <= most
        live = np.flatnonzero(fits)
        x, y = a[live] + found[live], b[live] + found[live]
        same = rolling.raw(x, x + width) == rolling.raw(y, y + width)
        found[live[same]] += width
    shared[at + 1] = found
    return shared


def _repeats(words: Words, hashes: np.ndarray, least: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: words under repeats of `least` words or more, and the longest repeat."""
    n = len(hashes)
    last = np.repeat(words.first[1:], words.counts)
    order, rank = suffix_array(hashes, words.doc, last)
    shared = common_prefixes(Rolling(hashes), order, words.doc, last)
    deepest = np.maximum(shared, np.r_[shared[1:], 0])[rank] if n else shared
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, words.doc, deepest)
    at = np.flatnonzero(deepest >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + deepest[at], -1)
    return per_row(np.cumsum(change)[:-1] > 0, words.first), longest


def _second(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again, and did it occur before?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again | before, before


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    rolling, words = Rolling(data), Words(data, offsets)
    hashes = words.hashes(rolling)
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = per_row(words.ink & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = per_row(SYMBOLS[data], offsets)
    ends = np.unique(np.r_[np.flatnonzero(data == 10), offsets[1:]])
    begins = np.r_[0, np.where(np.isin(ends, offsets), ends, ends + 1)][:-1]
    begins = np.unique(np.r_[begins, offsets[:-1], np.flatnonzero(data == 10) + 1])
    begins = begins[begins < len(data)]
    stops = np.minimum.reduce([np.r_[begins[1:], len(data)], offsets[np.searchsorted(offsets, begins, "right")]]) if len(begins) else begins
    newline = np.zeros(len(begins), bool)
    if len(begins):
        newline = data[stops - 1] == 10
    stops = stops - newline
    busy = np.searchsorted(words.starts, stops) > np.searchsorted(words.starts, begins)
    begins, stops = begins[busy], stops[busy]
    line_doc = np.searchsorted(offsets, begins, "right") - 1
    _, before = _second(mix(rolling(begins, stops) + mix(line_doc.astype(U) + U(7))))
    out["n_dup_lines"] = np.bincount(line_doc[before], minlength=texts)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = words.doc[2:] == words.doc[:-2]
        at = np.flatnonzero(whole)
        keys = mix(hashes[at] + mix(hashes[at + 1] + mix(hashes[at + 2] + mix(words.doc[at].astype(U)))))
        often, _ = _second(keys)
        for k in range(3):
            covered[at[often] + k] = True
    out["n_repeat_words"] = per_row(covered, words.first)
    spans, longest = _repeats(words, hashes, min_repeat, texts)
    out["covered_words"], out["longest_repeat"] = spans, longest
    n = out["n_words"]
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    out["kept"] = ~out["base_failed"] & (spans <= max_covered * n) & (longest <= max_repeat)
    return out


def quality_rules(docs: DataFrame, min_repeat: int = 13, max_covered: float = 0.2, max_repeat: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per text: `id_col`, the counts, `covered_words`, `longest_repeat`, `base_failed`, `kept`, and `row` if `carry` names columns."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []))
    fields = [given.schema["id"], *([given.schema["row"]] if carry else [])]

    def job(batches):
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                out = measure(data, offsets, min_repeat, max_covered, max_repeat)
                kept = [batch.column(f.name).slice(i, j - i) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in out.values())], names=[*(f.name for f in fields), *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + RESULT
    return given.mapInArrow(job, schema).withColumnRenamed("id", id_col)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
