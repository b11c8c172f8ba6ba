"""Language-model scoring with a small causal self-attention model in numpy (operator 6).

A text is its words and one end, for the base score and for the model; the model takes
them as byte-level BPE ids, each word with a space before it. Consecutive texts of a task
form a block, one row of a written table: its distinct words with their ids and training
counts, and the texts as places in that list, so that each word is encoded once a block.
The corpus gives, by Spark aggregation over all training texts, the counts of words (for
the base score), of ids, of neighbours and of what follows two neighbours. The commonest
2047 ids are symbols, all others share one more and are told apart in it by their counts. Symbols
are grouped into 32 classes, by the symbols that they follow. Attention over a window of
32 ids predicts the class: it weighs the corpus's own probabilities of classes after the
last two symbols (pairs share `BUCKETS` rows of counts by hash, smoothed by the last
symbol's); the symbol within its class follows from the neighbour counts. Each task
trains on its windows, and parameters are averaged by tokens, in two steps so that no
task takes more than the root of their number, for `rounds` rounds. A round takes every
`rounds`-th window by hash, so that each window of every training text is trained on once.

Scoring cuts each text into windows that overlap; a window scores its last 24 ids only,
so each token is scored once with 8 to 31 ids of context. What is further back comes in by
two guesses of the next id: the one that mostly followed the last `CUE` ids in training
texts (a table of `GUESSES` rows by hash; ids that lead in different readings are set off against each other), and the one that
followed the last `RECENT` ids when the text itself last had them. A guess has a
probability, and the rest is left to the model; it comes from how often guesses of its
kind (by the vote's share, and by how many guesses before were right in a row) have been right in
this text so far, so every text's probabilities still sum to one. For the base score a block
counts its own training words, and only words that other blocks hold too are sent to it
with their counts in all; words are dealt to slices by their hashes for that. With `lower`, as in the
query, A-Z count as a-z for words and model alike.

Defined cases: a null or empty text, or one of white space, is its end alone; null ids count as training rows;
rows that repeat an id are texts of their own; texts of any length are scored whole;
without training texts all counts are 0 and the model stays as it began; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, removed, written
from .text import Rolling, U, Words, mix, pieces

CONTEXT, NEW, WIDTH, CLASSES, INPUTS, ALONE = 8, 24, 8, 32, 2048, 20
SPAN, PAD = CONTEXT + NEW, INPUTS
BUCKETS = 1 << 18  # rows of class counts after two symbols
CUE, RECENT, GUESSES = 4, 3, 1 << 20  # ids that a guess rests on, by the corpus and by the text itself; rows of the corpus's
RIGHT, TRUST = np.array([0.03, 0.4, 0.7, 0.9]), 3.0  # before a text shows otherwise: the share of guesses that are right after 0, 1, 3 and 8 right ones; it counts as so many guesses
KNOWN = 1 << 18  # words whose ids a process keeps, some 10 MB
SLICE = 1 << 16  # cells of a table of counts that travel as one row
LED = 1 << 20  # leaders of all tasks that a task brings together at most, some 24 MB; the rows of guesses are cut by it
BYTES = 8 << 20  # that reach Python at a time, one block or more
BATCH, CHUNK = 256, 256  # windows of a training step; those that are worked on at a time, enough for numpy's calls to weigh little
END = int(mix(np.array([12345], U)).view(np.int64)[0])  # stands for the end among the words' hashes
SHAPES = {"embed": (INPUTS + 1, WIDTH), "place": (SPAN, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}


@lru_cache(maxsize=2)
def coder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


@lru_cache(maxsize=2)
def _id_sizes(path: str) -> np.ndarray:
    enc, end = coder(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(end)])


def encode(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words with a space before each, one word after the other, and where each word's begin."""
    return encoded(b"".join(b" " + w for w in words), np.r_[0, np.cumsum([len(w) + 1 for w in words], dtype=np.int64)], path)


def spelt(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words data[lo:hi] with a space before each, one after the other, and where each one's space stands."""
    begins = np.r_[0, np.cumsum(hi - lo + 1)]
    out = data.take(np.arange(begins[-1]) + np.repeat(lo - 1 - begins[:-1], hi - lo + 1), mode="clip") if len(data) else np.zeros(begins[-1], np.uint8)
    out[begins[:-1]] = 0x20
    return out.tobytes(), begins


def encoded(text: bytes, begins: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As encode(), of words that are spelt already."""
    enc, sizes = coder(path)[0], _id_sizes(path)
    ids = enc.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()).astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes[ids])]
    first = np.searchsorted(starts, begins)
    if (starts[np.minimum(first, len(ids))] == begins).all():
        return ids, first
    each = [enc.encode_ordinary(text[a:b].decode("utf-8", "replace")) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]  # an id lies across two words
    return np.array([i for x in each for i in x], np.int64), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]


class Coded:
    """Ids of words that a process has met already, told by their hashes: `KNOWN` words at most, those that a block has twice."""

    def __init__(self):
        self.tokens, self.first, self.many, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encoded(self, tokens: np.ndarray, n: np.ndarray, data: np.ndarray, where: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), of words with hashes `tokens` that a block has n times, the first time at `where` in data."""
        at = np.searchsorted(self.tokens, tokens)
        new = np.flatnonzero(self.tokens.take(at, mode="clip") != tokens) if len(self.tokens) else np.arange(len(tokens))
        more, begins = encoded(*spelt(data, *where[new].T), path)
        first, many = (x.take(at, mode="clip") if len(x) else np.zeros(len(at), np.int64) for x in (self.first, self.many))
        first[new], many[new] = begins[:-1] + len(self.ids), np.diff(begins)
        ends = np.r_[0, np.cumsum(many)]
        every = np.concatenate([self.ids, more.astype(np.int32)])
        ids = every[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])]
        own = new[n[new] > 1][: KNOWN - len(self.tokens)]
        if len(own):
            all_tokens, held = np.concatenate([self.tokens, tokens[own]]), np.concatenate([self.many, many[own]])
            self.ids = np.concatenate([self.ids, ids[np.repeat(ends[own] - np.cumsum(many[own]) + many[own], many[own]) + np.arange(many[own].sum())]])
            order, begins = np.argsort(all_tokens), np.r_[self.first, len(every) - len(more) + np.cumsum(many[own]) - many[own]]
            self.tokens, self.first, self.many = all_tokens[order], begins[order], held[order]
        return ids.astype(np.int64), ends


@lru_cache(maxsize=2)
def _met(path: str) -> Coded:
    return Coded()


def symbols(counts: np.ndarray) -> np.ndarray:
    """The commonest ids in order; all others share the last symbol."""
    return np.lexsort((np.arange(len(counts)), -counts))[: INPUTS - 1]


def grouped(pairs: np.ndarray) -> np.ndarray:
    """Class of each symbol: the commonest have one of their own, the rest share by the symbols that they follow."""
    cls = np.minimum(np.arange(INPUTS), CLASSES - 1)
    shape = np.sqrt(pairs[:, ALONE:].T / np.maximum(1, pairs[:, ALONE:].sum(0))[:, None])
    middle = shape[: CLASSES - ALONE]
    for _ in range(8):
        own = (shape @ middle.T).argmax(1)
        middle = np.stack([shape[own == k].mean(0) if (own == k).any() else middle[k] for k in range(len(middle))])
        middle /= np.maximum(1e-9, np.linalg.norm(middle, axis=1, keepdims=True))
    cls[ALONE:] = ALONE + own
    return cls


def buckets(two: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The row of counts for the last two symbols."""
    return (mix(two.astype(U) * U(INPUTS + 1) + last.astype(U)) >> U(64 - 18)).astype(np.int64)


def cues(ids: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k ids before each place in its text, of fewer at its begin."""
    out, odd = np.zeros(len(ids), U), mix(np.arange(1, k + 1, dtype=U)) | U(1)
    sizes = np.diff(offsets)
    for j in range(1, k + 1):
        before = np.zeros(len(ids), U)
        before[j:] = ids[:-j] + 1
        for i in range(j):
            before[offsets[:-1][sizes > i] + i] = 0
        out += before * odd[j - 1]
    return mix(out)


def rows_of(cue: np.ndarray) -> np.ndarray:
    return (cue >> U(64 - 20)).astype(np.int64)


class Votes:
    """Of each row of the guesses: the id that leads, the votes that it has left after those of other readings' leaders, and all that were cast."""

    def __init__(self, kinds: int):
        self.kinds, self.id, self.left, self.cast = kinds, np.full(GUESSES, -1, np.int32), np.zeros(GUESSES, np.int32), np.zeros(GUESSES, np.int32)

    def add(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        cells, n = np.unique(rows_of(cues(ids, offsets, CUE)) * self.kinds + ids, return_counts=True)
        row, own = np.divmod(cells, self.kinds)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        if not len(first):
            return
        most = np.maximum.reduceat(n * self.kinds + self.kinds - 1 - own, first)
        row, n, top, own = row[first], np.add.reduceat(n, first), most // self.kinds, self.kinds - 1 - most % self.kinds
        left, same = self.left[row], self.id[row] == own
        self.id[row] = np.where(same | (left >= top), self.id[row], own)
        self.left[row] = np.where(same, left + top, abs(left - top))
        self.cast[row] += n.astype(np.int32)


def recent(ids: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What followed the last `RECENT` ids when the text last had them; -1: it had not."""
    cue = mix(cues(ids, offsets, RECENT) + text.astype(U) * U(0x9E3779B97F4A7C15))
    bits = U(len(ids).bit_length())
    both = np.sort(cue >> bits << bits | np.arange(len(ids), dtype=U))  # sorting numbers is faster than sorting places
    order = (both & ((U(1) << bits) - U(1))).astype(np.int64)
    alike, same = both[1:] >> bits == both[:-1] >> bits, cue[order[1:]] == cue[order[:-1]]
    if (alike != same).any():  # two cues agree in the bits that were left
        order = np.argsort(cue, kind="stable")
        same = cue[order[1:]] == cue[order[:-1]]
    same, out = np.flatnonzero(same), np.full(len(ids), -1, np.int64)
    out[order[same + 1]] = ids[order[same]]
    return out


def with_guesses(said: np.ndarray, ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, guess: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """log10 probabilities of ids where a guess (-1: none) of one of four kinds takes its share of what the model said."""
    return np.log10(guessed(10**said, ids, offsets, text, guess, kind))


def guessed(said: np.ndarray, ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, guess: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """As with_guesses(), of probabilities."""
    at = np.flatnonzero(guess >= 0)
    if not len(at):
        return said
    right = guess == ids
    wrong = np.r_[-1, np.maximum.accumulate(np.where(right, -1, np.arange(len(ids))))]  # the last wrong place before each
    row = at - 1 - np.maximum(wrong[at], offsets[text[at]] - 1)
    state = (kind[at] * 4 + (row > 0) + (row > 2) + (row > 7)).astype(np.uint8)
    order = np.argsort(state, kind="stable")  # states in turn, each in the order of texts and places
    at, state = at[order], state[order]
    own, right = text[at], right[at]
    since = np.maximum.accumulate(np.where(np.r_[True, (own[1:] != own[:-1]) | (state[1:] != state[:-1])], np.arange(len(at)), 0))  # the state's first place in this text
    had = np.cumsum(right) - right
    share = (had - had[since] + (TRUST * RIGHT)[state & 3]) / (np.arange(len(at)) - since + TRUST)
    out = said.copy()
    out[at] = (1 - share) * said[at] + share * right
    return out


class Symbols:
    """The symbol of each id, and its probability within its symbol."""

    def __init__(self, counts: np.ndarray):
        order = symbols(counts)
        self.symbol = np.full(len(counts), INPUTS - 1, np.int64)
        self.symbol[order] = np.arange(len(order))
        rest = self.symbol == INPUTS - 1
        self.within = np.where(rest, (counts + 0.5) / (counts[rest].sum() + 0.5 * rest.sum() or 1), 1.0)
        self.share = np.bincount(self.symbol, counts + 0.5, INPUTS) + 1e-9

    def neighbours(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id: the symbols two and one before (PAD: none), and its own."""
        own = self.symbol[ids]
        starts = offsets[:-1][np.diff(offsets) > 0]
        last = np.r_[PAD, own[:-1]][: len(own)]
        last[starts] = PAD
        two = np.r_[PAD, last[:-1]][: len(own)]
        two[starts] = PAD
        return two, last, own


class Corpus:
    """What the model knows of ids by counting: neighbours' probabilities, and those of classes after two symbols.

    pairs: a row a symbol before (the last row: a text's begin), a column a symbol after.
    """

    def __init__(self, known: Symbols, pairs: np.ndarray):
        self.symbol, self.within, self.known = known.symbol, known.within, known
        kinds = (pairs > 0).sum(1, keepdims=True) + 1
        after = (pairs + kinds * (known.share / known.share.sum())) / (pairs.sum(1, keepdims=True) + kinds)
        self.cls = grouped(pairs)
        member = np.zeros((INPUTS, CLASSES))
        member[np.arange(INPUTS), self.cls] = 1
        by_class = np.maximum(after @ member, 1e-12)
        self.follows = (by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
        self.told = (after / by_class[:, self.cls]).astype(np.float32)
        self.seen, self.rest = np.zeros((BUCKETS, CLASSES), np.float32), np.ones(BUCKETS, np.float32)
        self.guess, self.kind = np.full(GUESSES, -1, np.int32), np.zeros(GUESSES, np.int8)

    def add(self, cells: np.ndarray, n: np.ndarray) -> None:
        """Counts of cells bucket * CLASSES + class."""
        self.seen.reshape(-1)[cells] = n
        kinds = (self.seen > 0).sum(1)
        total = np.maximum(1, self.seen.sum(1) + kinds)
        self.rest = np.where(kinds > 0, kinds / total, 1).astype(np.float32)
        self.seen /= total[:, None].astype(np.float32)

    def vote(self, row: np.ndarray, own: np.ndarray, left: np.ndarray, cast: np.ndarray) -> None:
        """Guesses of the corpus; kinds: below a third of the votes, below two thirds, one vote alone, more."""
        self.guess[row] = own
        self.kind[row] = np.where(cast == 1, 2, (3 * left >= cast).astype(np.int8) + 2 * (3 * left >= 2 * cast))

    def before(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes at the places that windows x score."""
        last = x[:, CONTEXT:]
        row = buckets(x[:, CONTEXT - 1 : -1], last).ravel()
        out, last = np.empty((len(row), CLASSES), np.float32), last.ravel()
        for a in range(0, len(row), CHUNK * NEW):
            part, own, at = out[a : a + CHUNK * NEW], last[a : a + CHUNK * NEW], row[a : a + CHUNK * NEW]
            self.follows.take(own, axis=0, out=part, mode="clip")
            part *= self.rest.take(at)[:, None]
            part += self.seen.take(at, axis=0, mode="clip")
        return out.reshape(len(x), NEW, CLASSES)


def start(seed: int = 5) -> dict[str, np.ndarray]:
    """Before training nothing is added to what the counts say."""
    r = np.random.default_rng(seed)
    p = {k: (r.normal(size=s) * 0.2).astype(np.float32) for k, s in SHAPES.items()}
    p["out"] *= 0
    return p


def windows(symbol: np.ndarray, ids: np.ndarray, offsets: np.ndarray, chosen=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, SPAN), targets (n, NEW; -1: none), and each window's text and number in it. An input is the symbol before its place. chosen: of the windows' texts and numbers, which ones to make."""
    sizes = np.diff(offsets)
    count = -(-sizes // NEW)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if chosen is not None:
        some = chosen(text, number)
        text, number = text[some], number[some]
    place = (number * NEW - CONTEXT)[:, None] + np.arange(SPAN)[None, :]
    at = offsets[text][:, None] + place
    size = sizes[text][:, None]
    x = np.where((place >= 1) & (place <= size), symbol[ids].take(at - 1, mode="clip"), PAD)
    y = np.where(place[:, CONTEXT:] < size, at[:, CONTEXT:], -1)
    return x, y, text, number


_CELLS = np.arange((INPUTS + 1) * WIDTH).reshape(-1, WIDTH)
_LATER = np.where(np.arange(SPAN)[None, :] > np.arange(NEW)[:, None] + CONTEXT, np.float32(-1e9), np.float32(0))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (windows, places, n) by b (n, m), as one product."""
    return (a.reshape(-1, a.shape[-1]) @ b).reshape(*a.shape[:2], -1)


def meeting(p: dict) -> np.ndarray:
    """Query by key: what makes a place's weight of two inputs, with no keys of their own."""
    return p["query"] @ p["key"].T * WIDTH**-0.5


def forward(p: dict, before: np.ndarray, x: np.ndarray, met: np.ndarray | None = None) -> tuple:
    """before: the counts' probabilities of classes. met: as of meeting(). s, z: weights of the places and their sums; mean: of what they weigh. The last two: weights of the classes, and their sums."""
    e = p["embed"].take(x, axis=0)
    e += p["place"]
    late = np.ascontiguousarray(e[:, CONTEXT:])
    q = _times(late, meeting(p) if met is None else met)
    s = q @ e.transpose(0, 2, 1)
    np.clip(s, -60, 60, out=s)  # in place of taking the largest away: no sum overflows or is 0
    s += _LATER
    np.exp(s, out=s)
    z = _times(s, np.ones((SPAN, 1), s.dtype))
    mean = s @ e
    mean /= z
    h = _times(mean, p["value"])
    h += late
    w = _times(h, p["out"])
    np.clip(w, -40, 40, out=w)
    np.exp(w, out=w)
    w *= before
    return e, late, q, s, z, mean, h, w, _times(w, np.ones((CLASSES, 1), w.dtype))[..., 0]


def gradients(p: dict, before: np.ndarray, x: np.ndarray, c: np.ndarray) -> dict:
    """Of the mean negative log probability of classes c (-1: none)."""
    n, out, met = max(1, int((c >= 0).sum())), {}, meeting(p)
    for a in range(0, len(x), CHUNK):
        for name, g in _gradients(p, before[a : a + CHUNK], x[a : a + CHUNK], c[a : a + CHUNK], n, met).items():
            out[name] = out[name] + g if a else g
    return out


def _gradients(p: dict, before: np.ndarray, x: np.ndarray, c: np.ndarray, n: int, met: np.ndarray) -> dict:
    e, late, q, s, z, mean, h, w, total = forward(p, before, x, met)
    seen = c >= 0
    share = (seen / n).astype(w.dtype)
    g = w
    g *= (share / total)[..., None]
    g.reshape(-1)[np.arange(0, g.size, CLASSES) + np.maximum(c, 0).ravel()] -= share.ravel()  # places without a class have no share
    flat = lambda a: a.reshape(-1, a.shape[-1])
    out = {"out": (flat(g).T @ flat(h)).T}
    dh = _times(g, p["out"].T)
    out["value"] = flat(mean).T @ flat(dh)
    d = _times(dh, p["value"].T)
    ds = d @ e.transpose(0, 2, 1)
    ds -= _times(mean * d, np.ones((WIDTH, 1), d.dtype))  # what the weights of a place's row sum to
    s /= z
    ds *= s
    de = s.transpose(0, 2, 1) @ d
    de += ds.transpose(0, 2, 1) @ q
    dq = ds @ e
    dmet = flat(late).T @ flat(dq) * WIDTH**-0.5
    dh += _times(dq, met.T)
    de[:, CONTEXT:] += dh
    embed = np.bincount(_CELLS.take(x.ravel(), axis=0).ravel(), de.ravel(), p["embed"].size).reshape(p["embed"].shape).astype(de.dtype)
    return out | {"query": dmet @ p["key"], "key": dmet.T @ p["query"], "embed": embed, "place": de.sum(0)}


def train(p: dict, batches, rate: float = 0.01) -> tuple[dict, int]:
    """Adam over batches of (inputs, the counts' probabilities, classes); returns parameters and tokens seen."""
    flat = _flat(p)
    p, m, w, tokens = _parts(flat), np.zeros_like(flat), np.zeros_like(flat), 0
    for step, (x, before, c) in enumerate(batches, 1):
        tokens += int((c >= 0).sum())
        pace = np.float32(rate * min(1, step / 20) / (1 - 0.9**step))
        g = _flat(gradients(p, before, x, c))
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        m[abs(m) < 1e-20] = 0  # such numbers would only slow the core down
        w *= np.float32(0.98)
        g *= g
        g *= np.float32(0.02)
        w += g
        by = np.sqrt(w / np.float32(1 - 0.98**step))
        by += np.float32(1e-8)
        flat -= pace * m / by
    return p, tokens


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def _parts(flat: np.ndarray) -> dict:
    """Views of the parameters, by name."""
    ends = np.cumsum([np.prod(s) for s in SHAPES.values()])
    return {k: x.reshape(s) for (k, s), x in zip(SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}


def _named(flat: np.ndarray) -> dict:
    return _parts(flat.astype(np.float32))


def _block_fields(kind: str) -> str:
    return f"part long, id array<{kind}>, held array<boolean>, sizes binary, words binary, tokens binary, n binary, ids binary, many binary"


def _encode_job(path: str, block: int, lower: bool):
    """Blocks of about `block` bytes of texts. sizes: tokens of each text; words: their places in tokens; n: tokens' training counts; ids, many: ids of all tokens, and their number by token."""
    _, end = coder(path)

    def made(number, rows, texts):
        hashes, doc, where = (np.concatenate(x) for x in zip(*((h, d, w) for h, d, w, _ in texts), strict=True))
        data = np.concatenate([x for *_, x in texts])
        held = np.concatenate([np.asarray(b.column("held")) for b in rows])
        coded = pa.array(hashes).dictionary_encode()
        word, tokens = np.asarray(coded.indices).astype(np.int64), np.asarray(coded.dictionary)
        at = np.flatnonzero(np.r_[True, word[1:] > np.maximum.accumulate(word)[:-1]])  # the dictionary's order is that of first places
        often = np.bincount(word)
        order = np.argsort((65535 - np.minimum(often, 65535)).astype(np.uint16), kind="stable")  # common words have small places, which compress well
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens, at, word = tokens[order], at[order], place[word]
        ids, first = _met(path).encoded(tokens, often[order], data, where[at], path)  # the end: no letters
        alone = int(np.flatnonzero(tokens == END)[0])
        keep = np.ones(len(ids), bool)
        keep[first[alone] + 1 : first[alone + 1]] = False
        ids[first[alone]] = end
        pack = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
        planes = lambda x: pack(np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T, np.uint8)  # noqa: E731  # low bytes first: they compress better
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        column = lambda c: pa.concat_arrays([b.column(c) for b in rows])
        return pa.RecordBatch.from_arrays([
            pa.array([number]), listed(column("id")), listed(column("held")), pack(np.bincount(doc, minlength=len(held)), np.int64), planes(word),
            pack(tokens, np.int64), pack(np.bincount(word, ~held[doc], len(tokens)), np.int64), planes(ids[keep]), planes(np.add.reduceat(keep, first[:-1])),
        ], names=["part", "id", "held", "sizes", "words", "tokens", "n", "ids", "many"])

    def job(batches):
        number, rows, texts, size, count = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), 1 << 18):
                if lower:
                    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
                words = Words(data, offsets)
                n = j - i
                own, ends = np.arange(len(words.doc)) + words.doc, words.first[1:] + np.arange(n)  # each text's words, then its end
                hashes, doc, where = np.full(len(own) + n, END), np.empty(len(own) + n, np.int64), np.zeros((len(own) + n, 2), np.int64)
                hashes[own], doc[own], doc[ends] = words.hashes(Rolling(data)).view(np.int64), words.doc, np.arange(n)
                where[own, 0], where[own, 1] = words.starts + size, words.ends + size
                texts.append((hashes, doc + count, where, data))
                rows.append(batch.slice(i, n))
                size, count = size + len(data), count + n
                if size >= block:
                    yield made(number, rows, texts)
                    number, rows, texts, size, count = number + 1, [], [], 0, 0
        if rows:
            yield made(number, rows, texts)

    return job


def _numbers(batch, row: int, column: str, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_py(), kind)


def _planed(batch, row: int, column: str) -> np.ndarray:
    return np.ascontiguousarray(_numbers(batch, row, column, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _texts(batch: pa.RecordBatch, learning: bool, limit: int = 1 << 17):
    """Of the batch's blocks: the block's row, consecutive texts [i, j) of about `limit` ids, all ids and where each text's begin; with `learning` the training texts alone."""
    for b in range(len(batch)):
        sizes, words = _numbers(batch, b, "sizes", np.int64), _planed(batch, b, "words")
        ids, many = _planed(batch, b, "ids"), _planed(batch, b, "many").astype(np.int64)
        first = np.cumsum(many) - many
        if learning:
            own = ~np.asarray(batch.column("held")[b].values)
            sizes, words = sizes[own], words[np.repeat(own, sizes)]
        ends = np.r_[0, np.cumsum(sizes)]
        reach = np.r_[0, np.cumsum(many[words])][ends]
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(reach, reach[i] + limit, "right")) - 1)
            word = words[ends[i] : ends[j]]
            count = many[word]
            at = np.repeat(first[word] - (np.cumsum(count) - count), count)
            at += np.arange(reach[j] - reach[i])
            yield b, i, j, ids[at].astype(np.int64), reach[i : j + 1] - reach[i]
            i = j


def _word_job(slices: int):
    """Rows (slice, part, tokens, n) of the distinct words of blocks, dealt by the words' hashes; n: in training texts."""

    def job(batches):
        for batch in batches:
            for b in range(len(batch)):
                tokens, n = _numbers(batch, b, "tokens", np.int64), _numbers(batch, b, "n", np.int64).astype(np.int32)
                own = (tokens.view(U) % U(slices)).astype(np.uint16 if slices < 1 << 16 else np.int64)
                order, ends = np.argsort(own, kind="stable"), np.r_[0, np.cumsum(np.bincount(own, minlength=slices))]
                tokens, n, some = tokens[order], n[order], np.flatnonzero(np.diff(ends))
                cut = lambda x: pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column("part")[b].as_py())), cut(tokens), cut(n)], names=["slice", "part", "tokens", "n"])

    return job


def shared_words(table: pa.Table) -> pa.Table:
    """Of one slice: by block the words that other blocks hold too and their counts in all; in sum, all training tokens of the slice and its distinct words in training texts."""
    each, n = [np.frombuffer(x.as_py(), np.int64) for x in table.column("tokens")], np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("n")]).astype(np.int64)
    tokens = np.concatenate(each)
    order = np.argsort(tokens)
    first = np.flatnonzero(np.r_[True, tokens[order[1:]] != tokens[order[:-1]]])
    held, sums = np.diff(np.r_[first, len(tokens)]), np.add.reduceat(n[order], first)
    total, more = np.empty(len(tokens), np.int64), np.empty(len(tokens), bool)
    total[order], more[order] = np.repeat(sums, held), np.repeat(held > 1, held)
    ends = np.r_[0, np.cumsum([len(x) for x in each])]
    cut = lambda x: pa.array([x[a:b][more[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    once = lambda x: pa.array(np.r_[x, np.zeros(len(each) - 1, np.int64)])
    return pa.table({"part": table.column("part"), "tokens": cut(tokens), "totals": cut(total), "all": once(n.sum()), "kinds": once((sums > 0).sum())})


def _sliced(have: np.ndarray, cut: int = SLICE, **values: np.ndarray):
    """Rows (part, cell, values...) of the cells that have any: `cut` cells a row, as bytes, so that millions of counts are some hundred rows; rows of `SLICE` cells in all are one batch."""
    for a in range(0, len(have), SLICE):
        rows = []
        for k in range(a // cut, -(-min(a + SLICE, len(have)) // cut)):
            own = slice(k * cut, (k + 1) * cut)
            at = np.flatnonzero(have[own])
            if len(at):
                rows.append((k, at.astype(np.uint16).tobytes(), *(x[own][at].tobytes() for x in values.values())))
        if rows:
            part, *columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["part", "cell", *values])


def _cells(part: int, cell, cut: int = SLICE) -> np.ndarray:
    return part * cut + np.frombuffer(cell.as_py(), np.uint16).astype(np.int64)


def _tally_job(cells: int, keys_of):
    """Slices of the counts of the keys that a function makes of ids and where texts begin, below a fixed number of cells."""

    def job(batches):
        have = np.zeros(cells, np.int32)
        for batch in batches:
            for *_, ids, ends in _texts(batch, True):
                np.add.at(have, keys_of(ids, ends), np.int32(1))
        yield from _sliced(have, n=have)

    return job


def _id_job(cells: int):
    """As _tally_job, of ids alone: a block's words say how often training texts have them."""

    def job(batches):
        have = np.zeros(cells, np.int64)
        for batch in batches:
            for b in range(len(batch)):
                n, ids, many = _numbers(batch, b, "n", np.int64), _planed(batch, b, "ids"), _planed(batch, b, "many")
                have += np.bincount(ids, np.repeat(n, many), cells).astype(np.int64)
        yield from _sliced(have, n=have.astype(np.int32))

    return job


def _sum_job(batches):
    """One row a slice, of all tasks' rows of it: counts of up to `SLICE` cells each are held."""
    have = {}
    for batch in batches:
        for k, cell, n in zip(batch.column("part").to_pylist(), batch.column("cell"), batch.column("n"), strict=True):
            own = have.setdefault(k, np.zeros(SLICE, np.int64))
            own[_cells(0, cell)] += np.frombuffer(n.as_py(), np.int32)
    for k, own in have.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["part", "cell", "n"])


def _tallied(blocks: DataFrame, job) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts in all."""
    kind = "part int, cell binary, n binary"
    table = _gathered(blocks.mapInArrow(job, kind).repartition("part").mapInArrow(_sum_job, kind))
    at = [_cells(k, cell) for k, cell in zip(table["part"].to_pylist(), table["cell"], strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(n.as_py(), np.int64) for n in table["n"])])


def _gathered(df: DataFrame) -> pa.Table:
    """All rows of a small result, whose shuffle files don't outlive it."""
    path = new_path(df.sparkSession)
    table = written(df, path).toArrow()
    removed(df.sparkSession, path)
    return table


def _vote_job(kinds: int, cut: int = SLICE):
    def job(batches):
        votes = Votes(kinds)
        for batch in batches:
            for *_, ids, ends in _texts(batch, True, 1 << 19):
                votes.add(ids, ends)
        yield from _sliced(votes.cast, cut, own=votes.id, left=votes.left, cast=votes.cast)

    return job


def together(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in values)


def _lead_job(kinds: int):
    """One row a slice of the guesses, of all tasks' rows of it: by row the id with the most votes left, those, and all that were cast."""

    def job(batches):
        have, new = {}, {}
        for batch in batches:
            for k, *row in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("cell", "own", "left", "cast")), strict=True):
                own, left, cast = (np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in row[1:])
                some = have.setdefault(k, [])
                some.append((_cells(0, row[0]) * kinds + own, left, cast))
                new[k] = new.get(k, 0) + len(own)
                if new[k] > max(1 << 19, len(some[0][0])):
                    have[k], new[k] = [together(*map(np.concatenate, zip(*some, strict=True)))], 0
        for k, some in have.items():
            key, left, cast = together(*map(np.concatenate, zip(*some, strict=True)))
            row = key // kinds
            order = np.lexsort((key, -left, row))
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            top = order[first]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (row[first].astype(np.uint16), key[top] % kinds, left[top], np.add.reduceat(cast, first)))], names=["part", "cell", "own", "left", "cast"])

    return job


def cut_for(tasks: int) -> int:
    """Rows of the guesses in a slice, so that what tasks lead with there is `LED` at most: each can name another id in each row."""
    return min(SLICE, 1 << max(0, (LED // max(1, tasks)).bit_length() - 1))


def _voted(blocks: DataFrame, kinds: int) -> tuple[np.ndarray, ...]:
    """Rows of the guesses, their ids, votes left and votes cast, over all tasks: `GUESSES` rows at most. One slice a task, as leaders of several tasks hardly agree and are as many as the corpus's tasks."""
    kind, cut = "part int, cell binary, own binary, left binary, cast binary", cut_for(blocks.rdd.getNumPartitions())
    table = _gathered(blocks.mapInArrow(_vote_job(kinds, cut), kind).repartitionById(GUESSES // cut, F.col("part")).mapInArrow(_lead_job(kinds), kind))
    at = [_cells(k, cell, cut) for k, cell in zip(table["part"].to_pylist(), table["cell"], strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *at]), *(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in table[c])]) for c in ("own", "left", "cast"))


def in_turn(marks: np.ndarray, number: np.ndarray, rounds: int, turn: int) -> np.ndarray:
    """Which windows (the number-th of the text with a mark) a round trains on: each window in one of the rounds."""
    return np.flatnonzero(mix(marks + number.astype(U)) % U(rounds) == U(turn))


def _train_job(known, weights, rounds: int, turn: int):
    def job(batches):
        corpus = known.value

        def some():
            xs, cs, have = [], [], 0
            for *_, ids, ends in (x for batch in batches for x in _texts(batch, True)):
                marks = Rolling(ids.astype(U))(ends[:-1], ends[1:])
                x, y, *_ = windows(corpus.symbol, ids, ends, lambda text, number: in_turn(marks[text], number, rounds, turn))  # noqa: B023
                xs.append(x)
                cs.append(np.where(y >= 0, corpus.cls[corpus.symbol[ids[np.maximum(y, 0)]]], -1))
                have += len(x)
                if have >= BATCH:
                    x, c = np.concatenate(xs), np.concatenate(cs)
                    for a in range(0, have - BATCH + 1, BATCH):
                        yield x[a : a + BATCH], corpus.before(x[a : a + BATCH]), c[a : a + BATCH]
                    have %= BATCH
                    xs, cs = [x[len(x) - have :]], [c[len(c) - have :]]
            if have:
                x = np.concatenate(xs)
                yield x, corpus.before(x), np.concatenate(cs)

        p, tokens = train(_named(weights.value), some(), 0.01 / (turn + 1))
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "weights": pa.array([_flat(p).astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([tokens], pa.int64())})

    return job


def _mean(table: pa.Table) -> pa.Table:
    """The mean of parameters, weighted by tokens."""
    total, n = np.zeros(1), 0
    for row, tokens in zip(table.column("weights"), table.column("tokens").to_pylist(), strict=True):
        total, n = total + np.frombuffer(row.as_py(), np.float32).astype(np.float64) * tokens, n + tokens
    return pa.table({"weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "tokens": pa.array([n], pa.int64())})


def averaged(learned: DataFrame, flat: np.ndarray) -> np.ndarray:
    """The mean over tasks: of groups of about the root of their number, then of the groups' means, as many again at most."""
    learned = written(learned.filter("tokens > 0"))
    groups = max(1, int(learned.count() ** 0.5))
    means = learned.groupBy(F.pmod(F.xxhash64("task"), F.lit(groups)).alias("g")).applyInArrow(_mean, "weights binary, tokens long").toArrow()
    return np.frombuffer(_mean(means).column("weights")[0].as_py(), np.float32).copy() if len(means) else flat


def log10_scores(p: dict, corpus: Corpus, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each text."""
    if not len(ids):
        return np.zeros(len(offsets) - 1)
    x, y, *_ = windows(corpus.symbol, ids, offsets)
    own, text = corpus.symbol[ids], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.flatnonzero(y >= 0)  # windows have their texts' ids in order
    cls = np.zeros(y.size, np.int64)
    cls[place] = corpus.cls[own]
    cls += np.arange(y.size) % (CHUNK * NEW) * CLASSES  # where it stands among a chunk's weights
    said, met = np.empty(y.size, np.float32), meeting(p)
    for a in range(0, len(x), CHUNK):
        b, part = x[a : a + CHUNK], slice(a * NEW, (a + CHUNK) * NEW)
        *_, w, total = forward(p, corpus.before(b), b, met)
        np.divide(w.ravel().take(cls[part]), total.ravel(), out=said[part])
    out = said[place] * corpus.within[ids]
    out *= corpus.told.ravel().take(x[:, CONTEXT:].ravel()[place] * INPUTS + own)
    row = rows_of(cues(ids, offsets, CUE))
    out = guessed(out, ids, offsets, text, corpus.guess[row], corpus.kind[row])
    out = guessed(out, ids, offsets, text, recent(ids, offsets, text), np.zeros(len(ids), np.int8))
    return np.bincount(text, np.log10(out), len(offsets) - 1)


def _score_job(known, weights):
    def job(batches):
        corpus, p = known.value, _named(weights.value)
        for batch in batches:
            scores = [np.zeros(len(x)) for x in batch.column("held")]
            for b, i, j, ids, ends in _texts(batch, False):
                scores[b][i:j] = log10_scores(p, corpus, ids, ends)
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([x.tobytes() for x in scores], pa.binary())], names=["part", "score"])

    return job


def _base_job(all_tokens: int, kinds: int):
    def each(table: pa.Table, shared: pa.Table):
        token, total = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in shared.column(c))]) for c in ("tokens", "totals"))
        for b in range(len(table)):  # one block
            score = np.frombuffer(shared.column("score").drop_null()[b].as_py(), np.float64)
            tokens, n, sizes = (_numbers(table, b, c, np.int64) for c in ("tokens", "n", "sizes"))
            words = _planed(table, b, "words")
            by_hash, n = np.argsort(tokens), n.copy()
            n[by_hash[np.searchsorted(tokens, token, sorter=by_hash)]] = total
            c, text, rows = n[words], np.repeat(np.arange(len(sizes)), sizes), len(sizes)
            yield pa.table({
                "id": table.column("id")[b].values, "held_out": table.column("held")[b].values, "n_tokens": sizes, "n_known": np.bincount(text[c > 0], minlength=rows), "train_tokens": np.full(rows, all_tokens),
                "base_score": np.bincount(text, np.log10((c + 0.5) / (all_tokens + 0.5 * (kinds + 1))), rows), "score": score,
            })

    return lambda table, shared: pa.concat_tables(list(each(table, shared)))


@contextmanager
def _small_batches(spark: SparkSession):
    """Blocks reach Python one by one: by Spark's own limit a task and its executor hold some 64 MB of them each, twice."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lm_scores(docs: DataFrame, path: str, rounds: int = 2, block_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text", lower: bool = False) -> DataFrame:
    """One row per text: `id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score. path: of a tiktoken file of ranks that every executor has. lower: A-Z are taken as a-z, all other characters as they are."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    kind = given.schema["id"].dataType.simpleString()
    coded = written(given.mapInArrow(_encode_job(path, block_bytes, lower), _block_fields(kind)))
    with _small_batches(spark):
        return _scored(coded, path, rounds, kind).withColumnRenamed("id", id_col)


def _scored(coded: DataFrame, path: str, rounds: int, kind: str) -> DataFrame:
    """As lm_scores(), of written blocks; kind: of the texts' id."""
    spark = coded.sparkSession
    slices = max(1, coded.count() // 8)  # as large at any size: that of the words of some blocks
    words = coded.select("part", "tokens", "n").mapInArrow(_word_job(slices), "slice int, part long, tokens binary, n binary")
    words = written(words.repartition(slices, "slice").groupBy("slice").applyInArrow(shared_words, "part long, tokens binary, totals binary, all long, kinds long"))
    all_tokens, kinds = (int(x or 0) for x in words.agg(F.sum("all"), F.sum("kinds")).first())
    learning, size = coded.select("held", "sizes", "words", "ids", "many"), coder(path)[1] + 1
    counts = np.zeros(size, np.int64)
    at, n = _tallied(coded.select("n", "ids", "many"), _id_job(size))
    counts[at] = n
    about = Symbols(counts)
    sent = spark.sparkContext.broadcast(about)
    pairs = np.zeros((INPUTS + 1) * INPUTS)

    def neighbours(ids, ends):
        _, last, own = sent.value.neighbours(ids, ends)
        return last * INPUTS + own

    at, n = _tallied(learning, _tally_job((INPUTS + 1) * INPUTS, neighbours))
    pairs[at] = n
    corpus = Corpus(about, pairs.reshape(INPUTS + 1, INPUTS))
    classes = spark.sparkContext.broadcast(corpus.cls)

    def after_two(ids, ends):
        two, last, own = sent.value.neighbours(ids, ends)
        return buckets(two, last) * CLASSES + classes.value[own]

    corpus.add(*_tallied(learning, _tally_job(BUCKETS * CLASSES, after_two)))
    corpus.vote(*_voted(learning, size))
    known = spark.sparkContext.broadcast(corpus)  # 55 MB: its size is that of the vocabulary, of INPUTS, of BUCKETS and of GUESSES
    flat = _flat(start())
    for turn in range(rounds):
        job = _train_job(known, spark.sparkContext.broadcast(flat), rounds, turn)
        flat = averaged(learning.mapInArrow(job, "task long, weights binary, tokens long"), flat)
    scores = written(coded.select("part", "held", "sizes", "words", "ids", "many").mapInArrow(_score_job(known, spark.sparkContext.broadcast(flat)), "part long, score binary"))
    told = words.select("part", "tokens", "totals", F.expr("cast(null as binary)").alias("score")).union(scores.select("part", F.expr("X''"), F.expr("X''"), "score"))
    return coded.select("part", "id", "held", "sizes", "words", "tokens", "n").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_base_job(all_tokens, kinds), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), lower=True)


QUERIES = {"op6_lm_scores": op6_lm_scores}
SQL: dict[str, str] = {}
