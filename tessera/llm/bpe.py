"""BPE encoding and decoding with forced boundaries (operator 3).

Two neighbouring bytes that no vocabulary token holds side by side can never be merged,
so every such place is a certain cut: the fragments between cuts are encoded one by one
and their ids put after each other. The pre-tokenizer's own cuts, and strings of added
tokens, are further cuts. Ids equal those of the `tokenizers` library for a byte-level
BPE file without normaliser (truncation, padding and special-token templates unused).

Work is kept small by units: a run of white space with the word after it, between which
the pre-tokenizer always cuts. Each unit is encoded once per worker (a bounded table)
and looked up after that.

Defined cases: a null or empty text has no ids; ids that the vocabulary lacks are an
error on decoding; bytes that are no UTF-8 decode to U+FFFD; texts of any length are
taken whole; equal rows get equal results; an empty table gives no rows; other columns
are ignored unless named in `carry`, which returns them inside the struct `row`.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SPACE, pieces

# The pre-tokenizer's pattern and the white space of Unicode.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

NEVER = np.iinfo(np.int32).max
UNITS = 500_000  # kept in a worker's table before it starts anew


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: the byte for each character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        letter = _alphabet()
        raw = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.byte_id = np.array([raw[bytes([b])] for b in range(256)], np.int32)
        pairs = [[bytes(letter[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        keys = np.array([(raw[a] << 20) | raw[b] for a, b in pairs])
        self.pair_rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.pair_keys = keys[self.pair_rank]
        self.pair_id = np.array([raw[a + b] for a, b in pairs], np.int32)[self.pair_rank]
        self.by_rank = np.argsort(self.pair_rank)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words are not supported")
        self.beside = np.zeros((256, 256), bool)
        for t in raw:
            for x, y in zip(t[:-1], t[1:], strict=True):
                self.beside[x, y] = True
        names = {i: t for t, i in raw.items()} | {i: t.encode() for t, i in self.added.items()}
        tokens = [names.get(i, b"") for i in range(max(names) + 1)]
        self.known = np.array([i in names for i in range(len(tokens))])
        self.lengths = np.array([len(t) for t in tokens])
        self.places = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        self.units: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def merge(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All fragments at once: in each round every fragment merges its pair of least rank, leftmost of overlapping ones. Returns ids and the byte where each begins."""
        ids, place = self.byte_id[data], np.arange(len(data))
        owner = np.zeros(len(data), np.int64)
        owner[begins] = 1
        owner = np.cumsum(owner)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = (ids[:-1].astype(np.int64) << 20) | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.full(len(ids), NEVER, np.int32)
            rank[:-1] = np.where((self.pair_keys[at] == key) & (owner[1:] == owner[:-1]), self.pair_rank[at], NEVER)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ended = least == NEVER
            done.append((place[ended], ids[ended]))
            hit = (rank == least) & ~ended
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            spot = np.flatnonzero(hit)
            hit[spot] = (spot - run[np.searchsorted(run, spot, "right") - 1]) % 2 == 0 if len(spot) else False
            spot = np.flatnonzero(hit)
            ids[spot] = self.pair_id[self.by_rank[rank[spot]]]
            stay = ~ended
            stay[spot + 1] = False
            ids, place, owner = ids[stay], place[stay], owner[stay]
        places, found = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        by = np.argsort(places, kind="stable")
        return found[by], places[by]

    def learn(self, units: list[bytes]) -> None:
        """Encodes units that are new to this worker's table."""
        plain = [u for u in units if u[0] <= 0x20 and SPACE[u[0]] and 0x20 < u[-1] < 0x7F]
        chosen = set(plain)
        rest = [u for u in units if u not in chosen]
        words = self.split.findall(b"".join(plain).decode("utf-8", "replace"))
        for u in rest:
            words += self.split.findall(u.decode("utf-8", "replace"))
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = True
        cut[np.cumsum([len(w) for w in raw])] = True
        cut[1:-1] |= ~self.beside[data[:-1], data[1:]]
        ids, places = self.merge(data, np.flatnonzero(cut[:-1]))
        order = plain + rest
        ends = np.cumsum([len(u) for u in order])
        sizes = np.bincount(np.searchsorted(ends, places, "right"), minlength=len(order))
        at = len(self.starts)
        self.units.update(zip(order, range(at, at + len(order)), strict=True))
        self.starts = np.r_[self.starts, self.used + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        if len(self.units) > UNITS:
            self.forget()
        if self.special is not None:
            whole = data.tobytes()
            marks = [t.encode() for t in self.added]
            if any(m in whole for m in marks):
                parts = [self._with_added(whole[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                return np.concatenate([np.zeros(0, np.int32), *parts]), np.r_[0, np.cumsum([len(p) for p in parts])]
        return self._plain(data, offsets)

    def _with_added(self, text: str) -> np.ndarray:
        out = [np.zeros(0, np.int32)]
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(np.array([self.added[part]], np.int32))
            elif part:
                raw = np.frombuffer(part.encode(), np.uint8)
                out.append(self._plain(raw, np.array([0, len(raw)]))[0])
        return np.concatenate(out)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        # a cut where ASCII white space follows a character that is surely no white space
        safe = (data > 0x20) & (data < 0x7F)
        high = data >= 0x80
        odd = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        two, three = np.zeros(n, bool), np.zeros(n, bool)
        two[1:] = odd[:-1]
        three[2:] = odd[:-2]
        safe |= high & ~two & ~three & ~odd
        cut = np.zeros(n, bool)
        cut[1:] = SPACE[data[1:]] & safe[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        begins = np.flatnonzero(cut)
        stops = np.r_[begins[1:], n]
        whole, get = data.tobytes(), self.units.get
        pick = list(map(whole.__getitem__, map(slice, begins.tolist(), stops.tolist())))
        found = list(map(get, pick))
        if None in found:
            self.learn(list({u for u, at in zip(pick, found, strict=True) if at is None}))
            found = list(map(get, pick))
        at = np.array(found)
        starts, sizes = self.starts[at], self.sizes[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begins, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all lists of ids, and where each list's begin."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.lengths[ids]
        ends = np.r_[0, np.cumsum(sizes)]
        return self.bytes[np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends[offsets]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One per worker and path, kept between tasks."""
    return Bpe(path)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes; those that are no UTF-8 are replaced."""
    raw = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _columns(docs: DataFrame, id_col: str, value: str, name: str, kind: str, carry: list[str] | None) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(value).cast(kind).alias(name), *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []))


def _schema(given: DataFrame, carry: list[str] | None) -> str:
    return "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in ("id", *(["row"] if carry else [])))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per text: `id_col`, ids (array of int), and `row` if `carry` names columns. path: of a tokenizer file that every executor has."""
    given = _columns(docs, id_col, text_col, "text", "string", carry)
    names = ["id", *(["row"] if carry else [])]

    def job(batches):
        bpe = load(path)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                ids, ends = bpe.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=[*names, "ids"])

    return given.mapInArrow(job, _schema(given, carry) + "ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """One row per list of ids: `id_col`, text, and `row` if `carry` names columns. A null list gives an empty text."""
    given = _columns(rows, id_col, ids_col, "ids", "array<int>", carry)
    names = ["id", *(["row"] if carry else [])]

    def job(batches):
        bpe = load(path)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            flat, ends = np.asarray(lists.flatten()), np.r_[0, np.cumsum(sizes)]
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 19), "right")) - 1)
                data, offsets = bpe.decode(flat[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), strings(data, offsets)], names=[*names, "text"])
                i = j

    return given.mapInArrow(job, _schema(given, carry) + "text string").withColumnRenamed("id", id_col)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = byte_bpe_path()
    encoded = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    told = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
    return bpe_decode(told, path, carry=["n_tokens", "ids_sha256"]).select("doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
SQL: dict[str, str] = {}
