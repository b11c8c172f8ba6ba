"""MinHash near-dedup by DartMinHash (operator 4).

Texts are sets of word shingles. Darts are thrown, by hash alone, at the plane of weight
and rank over each element; a dart counts for a text if it lands under the element's
weight. Each dart has a coordinate, and a text's signature keeps the dart of least rank
for each. Rank layers double in height, and a text looks at as many as it needs until
every coordinate has a dart, so a text of n shingles costs about n + k log k darts. Two
texts agree in a coordinate with the probability of their (weighted) similarity.

Coordinates are cut into bands. Texts that share a band are candidates, and the exact
similarity decides. It is that of plain sets, so all weights are 1 here; `signatures`
takes any. Texts with equal shingles are one class from the start, named by a hash of
them (aggregated before any shuffle). In each band's bucket every class is first compared
with the bucket's smallest, its hub. Where a bucket still holds several components, its
classes are dealt to blocks of a bounded size, those with one hub side by side; two blocks
are compared, once, if they meet in such a bucket. One task takes two blocks and
compares only sets of different components whose sizes and distances from a common hub
allow the similarity (by the triangle inequality: 1 - similarity is a metric); it returns
the components that it finds and no pairs. So no link found by the bands is lost, rows
grow with the texts, and only blocks, of `BLOCK` classes each, meet in pairs.

Defined cases: a null or empty text, or one of white space, is like no other and keeps
its own class; a text of fewer words than a shingle is one shingle; equal rows share a
class; rows that repeat an id with different texts are texts of their own, each with its
links; null ids are ids like others, but stand for a class only if it has no other id;
texts of any length are taken whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import written
from .text import Rolling, U, Words, mix, pieces

NO_ID = -(2**63)  # in place of a null id, for joins
DEEPEST = 24  # layers of rank below 2**-DEEPEST are one


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: hashes and where each text's begin."""
    words = Words(data, offsets)
    hashes = words.hashes(Rolling(data))
    n = len(offsets) - 1
    count = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    doc = np.repeat(np.arange(n), count)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(words.counts[doc], size)
    keys = mix(Rolling(hashes).raw(at, at + length) + length.astype(U))
    by = np.lexsort((keys, doc))
    keys, doc = keys[by], doc[by]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])][: len(keys)]
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(n + 1))


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the number of darts."""
    most = int(mean + 12 * mean**0.5 + 12)
    k = np.arange(most + 1)
    logs = k * np.log(mean) - mean - np.r_[0.0, np.cumsum(np.log(k[1:]))]
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def signatures(keys: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """One row of k numbers a text that has elements: the least dart for each coordinate. keys: distinct in each text; weights > 0."""
    n = len(first) - 1
    rate = k * np.log(k) + 2 * k
    doc = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(doc, weights, minlength=n)
    best = np.full(n * k, np.iinfo(U).max, U)
    # layer 0 holds ranks below 2**-DEEPEST, layer j those up to 2**(j-DEEPEST)
    enough = np.clip(DEEPEST - np.floor(np.log2(np.maximum(total, 1e-9))).astype(int), 0, 2 * DEEPEST)
    open_ = total > 0
    layer = 0
    while open_.any():
        own = open_[doc]
        e, d, w = keys[own], doc[own], weights[own]
        low, height = (0.0, 2.0**-DEEPEST) if layer == 0 else (2.0 ** (layer - 1 - DEEPEST), 2.0 ** (layer - 1 - DEEPEST))
        level = 0
        while len(e):  # weights below 1, from 1 to 2, from 2 to 4, ...
            floor, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            inside = w > floor
            if not inside.all():
                e, d, w = e[inside], d[inside], w[inside]
            if not len(e):
                break
            seed = mix(e + U((layer * 64 + level + 1) * 0x9E3779B97F4A7C15 % 2**64))
            spread = _poisson(rate * height * width)
            u = _unit(seed)
            some = np.flatnonzero(u >= spread[0])
            count = np.searchsorted(spread, u[some], "right")
            owner = np.repeat(some, count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(seed[owner] ^ mix((number + 1).astype(U)))
            if level or (w < width).any():
                hit = floor + width * _unit(mix(dart + U(1))) < w[owner]
                owner, dart = owner[hit], dart[hit]
            rank = (low + height * _unit(mix(dart + U(2)))).astype(np.float32).view(np.uint32).astype(U)
            np.minimum.at(best, d[owner] * k + (dart % U(k)).astype(np.int64), (rank << U(32)) | (dart >> U(32)))
            level += 1
        layer += 1
        late = np.flatnonzero(open_ & (enough < layer))
        if len(late):
            open_[late] = (best.reshape(n, k)[late] == np.iinfo(U).max).any(axis=1)
    return best.reshape(n, k)


def _class_keys(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's set of shingles."""
    sums = [np.r_[np.zeros(1, U), np.cumsum(mix(keys + U(x)))] for x in (9, 77)]
    a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
    return mix(a ^ mix(b + np.diff(first).astype(U))).view(np.int64)


def _signature_job(size: int, bands: int, rows: int):
    def job(batches):
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), 1 << 20):
                keys, first = shingles(data, offsets, size)
                best = signatures(keys, np.ones(len(keys)), first, bands * rows).reshape(j - i, bands, rows)
                codes = np.zeros((j - i, bands), U)
                for r in range(rows):
                    codes = mix(codes * U(0x9E3779B97F4A7C15) + best[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array((np.arange(j - i + 1) * bands).astype(np.int32)), pa.array(codes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("id", "mark")), pa.array(_class_keys(keys, first)), pa.array(np.diff(first)), lists], names=["id", "mark", "key", "n", "codes"])

    return job


def _shingle_job(size: int):
    def job(batches):
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text")):
                keys, first = shingles(data, offsets, size)
                yield pa.RecordBatch.from_arrays([pa.array(_class_keys(keys, first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["key", "set"])

    return job


def _compare_job(batches):
    """The similarity of each pair; sets are sorted as unsigned numbers."""
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        share = []
        for r in range(len(batch)):
            x, y = np.asarray(a[r].values), np.asarray(b[r].values)
            both = len(np.intersect1d(x, y, assume_unique=True))
            share.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())], names=["a", "b", "share"])


def _at_least(both, total, similarity: float):
    """Is both / total, of whole numbers, the similarity or more? No rounding decides at the limit."""
    return both >= similarity * total - 1e-9


def _block_job(table: pa.Table) -> pa.Table:
    """One row for a block: its classes, their sizes, components, hubs, distances from these, and sets."""
    table = table.sort_by("key")
    cells = table.select(["key", "component", "hub", "far", "set"]).combine_chunks().to_batches()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cells[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(cells[0])
    return pa.table({"block": table.column("block")[:1], "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _opened(packed: pa.Scalar) -> tuple:
    table = pa.ipc.open_stream(packed.as_py()).read_all().combine_chunks()
    sets = table.column("set").combine_chunks() if isinstance(table.column("set"), pa.ChunkedArray) else table.column("set")
    offsets = np.asarray(sets.offsets).astype(np.int64)
    return *(np.asarray(table.column(c)) for c in ("key", "component", "hub", "far")), np.asarray(sets.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def linked(a: tuple, b: tuple, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes of two blocks, and the smallest component that each reaches by links between the blocks."""
    (ka, ca, ha, fa, sa, oa), (kb, cb, hb, fb, sb, ob) = a, b
    codes = np.unique(np.r_[sa, sb], return_inverse=True)[1]
    sa, sb = codes[: len(sa)], codes[len(sa) :]
    na, nb = np.diff(oa), np.diff(ob)
    label = {c: c for c in np.r_[ca, cb].tolist()}

    def top(c):
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    now = np.array([top(c) for c in cb.tolist()])
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    for r in range(len(ka)):
        maybe = (now != top(int(ca[r]))) & (np.minimum(na[r], nb) >= similarity * np.maximum(na[r], nb) - 1e-9)
        maybe &= (ha[r] != hb) | (np.abs(fa[r] - fb) <= 1 - similarity + 1e-9)
        at = np.flatnonzero(maybe)
        if not len(at):
            continue
        own = sa[oa[r] : oa[r + 1]]
        seen[own] = True
        inside = np.r_[0, np.cumsum(nb[at])]
        hits = np.add.reduceat(seen[sb[np.repeat(ob[at] - inside[:-1], nb[at]) + np.arange(inside[-1])]].astype(np.int64), inside[:-1])
        seen[own] = False
        for k in at[_at_least(hits, na[r] + nb[at] - hits, similarity)]:
            x, y = sorted((top(int(ca[r])), top(int(cb[k]))))
            label[y] = x
            now[now == y] = x
    return np.r_[ca, cb], np.array([top(c) for c in np.r_[ca, cb].tolist()], np.int64)


def _meet_job(similarity: float):
    def job(table: pa.Table) -> pa.Table:
        blocks = {table.column("block")[r].as_py(): r for r in range(len(table))}
        opened = [_opened(table.column("packed")[blocks[k]]) for k in sorted(blocks)]
        was, now = linked(opened[0], opened[-1], similarity)
        moved = was != now
        found = np.unique(np.c_[was[moved], now[moved]], axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return job


BLOCK, BLOCK_SHINGLES = 512, 1 << 18  # classes, and shingles in all, that one block has on average at most


def _in_blocks(apart: DataFrame, sets: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of components. apart: band, code, key, n, hub, component, of buckets with several components."""
    home = apart.groupBy("key").agg(F.min("hub").alias("hub"), F.first("n").alias("n"), F.first("component").alias("component"))
    far = stars.select(F.col("a").alias("hub"), F.col("b").alias("key"), (1 - F.col("share")).alias("far"))
    home = home.join(far, ["hub", "key"], "left").withColumn("far", F.when(F.col("hub") == F.col("key"), 0.0).otherwise(F.coalesce("far", F.lit(1.0))))
    # without a known distance (sizes too different from the hub's) the hub is the class itself, so that it bounds nothing
    home = written(home.withColumn("side", F.when(F.col("far") < 1.0, F.col("hub")).otherwise(F.col("key"))).withColumn("far", F.when(F.col("far") < 1.0, F.col("far")).otherwise(0.0)))
    sizes = home.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    dealt = written(home.join(sizes, "hub").withColumn("block", F.when(F.col("parts") == 1, F.xxhash64("hub")).otherwise(F.xxhash64("hub", F.pmod(F.xxhash64("key"), F.col("parts"))))))
    blocks = written(
        dealt.join(sets, "key").select("block", "key", "component", F.col("side").alias("hub"), "far", "set")
        .groupBy("block").applyInArrow(_block_job, "block long, packed binary")
    )
    spots = apart.select("band", "code", "key").join(dealt.select("key", "block", "component"), "key").groupBy("band", "code", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    spots = written(spots)
    p, q = (spots.select("band", "code", *(F.col(c).alias(f"{c}{s}") for c in ("block", "x", "y"))) for s in "pq")
    meet = p.join(q, ["band", "code"]).filter("blockp <= blockq and (xp <> yp or xq <> yq or xp <> xq)").select("blockp", "blockq").distinct()
    pairs = written(meet).withColumn("block", F.explode(F.array_distinct(F.array("blockp", "blockq"))))
    return written(pairs.join(blocks, "block").groupBy("blockp", "blockq").applyInArrow(_meet_job(similarity), "a long, b long"))


def minhash_classes(docs: DataFrame, similarity: float = 0.8, size: int = 5, bands: int = 36, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: `id_col`, mark (xxhash64 of the text), class_id (smallest id of its class), kept (the text stands for its class: the smallest id, and of its texts the one of least mark)."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = written(given.mapInArrow(_signature_job(size, bands, rows), "id long, mark long, key long, n long, codes array<long>"))
    some = signed.filter("n > 0")
    stands = some.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least"), F.first("n").alias("n"), F.first("codes").alias("codes"))  # equal sets have equal codes
    stands = written(stands)
    spots = written(stands.select(F.col("least.id").alias("id"), "key", "n", F.posexplode("codes").alias("band", "code")))
    crowds = spots.groupBy("band", "code").agg(F.min(F.struct("id", "key", "n")).alias("hub"), F.count("*").alias("many")).filter("many > 1")
    crowded = written(spots.join(written(crowds), ["band", "code"]))
    close = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    pairs = written(crowded.filter(F.col("key") != F.col("hub.key")).filter(close(F.col("n"), F.col("hub.n"))).select(F.col("hub.key").alias("a"), F.col("key").alias("b")).distinct())
    # the sets of all classes that share a bucket, from one text of each
    wanted = crowded.select("key").distinct().join(stands.select("key", "least"), "key").select(F.coalesce("least.id", F.lit(NO_ID)).alias("k"), F.col("least.mark").alias("mark"))
    texts = given.withColumn("k", F.coalesce("id", F.lit(NO_ID))).join(wanted.hint("merge"), ["k", "mark"], "left_semi").select("text")  # the same plan at every size
    sets = written(texts.mapInArrow(_shingle_job(size), "key long, set array<long>").dropDuplicates(["key"]))
    stars = written(
        pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
        .mapInArrow(_compare_job, "a long, b long, share double")
    )
    links = stars.filter(F.col("share") >= similarity - 1e-12).select("a", "b")
    known = components(links)
    placed = crowded.filter("many > 2").join(known.withColumnRenamed("id", "key"), "key", "left").select("band", "code", "key", "n", F.col("hub.key").alias("hub"), F.coalesce("component", "key").alias("component"))
    mixed = placed.groupBy("band", "code").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band", "code")
    apart = written(placed.join(written(mixed), ["band", "code"]))
    more = _in_blocks(apart, sets, stars, similarity)
    found = components(links.union(known.select(F.col("id").alias("a"), F.col("component").alias("b"))).union(more)).withColumnRenamed("id", "key")
    told = stands.select("key", "least").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    best = told.groupBy("component").agg(F.min("least").alias("best"))
    named = written(told.join(best, "component").select("key", "best"))
    out = signed.select("id", "mark", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    alone, same = F.col("best").isNull(), F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    return out.select(F.col("id").alias(id_col), "mark", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"), F.when(alone, F.lit(True)).otherwise(same).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")


QUERIES = {"op4_minhash": op4_minhash}
SQL: dict[str, str] = {}
