"""Embedding near-dedup by cover trees and dual traversal (operator 7).

Equal vectors are one from the start, with their number. Distinct vectors are dealt to
blocks of a bounded size, and each block builds a cover tree: nested nets whose radii
halve, each node with its exact covering radius. Blocks are shipped in tiles of a few;
a pair of tiles is one group, and each pair of blocks in it
walks both trees at once, from the finest level that has not many more nodes than the coarsest: two nodes whose centres are further apart than the threshold
and both covering radii are left out with all below them, two that lie as near as their
radii allow are linked as a whole, and only what is left is opened. Pairs of vectors at
the bottom are compared in double precision, so links are exact.

A task reports link counts and, for connectivity, each vector's smallest mate in that
pair of blocks; pairs themselves are never listed. A large group of near copies is
spread over blocks.

Defined cases: vectors that are null, empty, zero, or hold a null, NaN or infinite
component link with nothing; vectors of different lengths don't link; rows that repeat
an id are vectors of their own, and count as links of each other if they are near; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import written

BLOCK = 2560
TILE = 8  # blocks that are shipped to a task together, with as many others: each block goes to fewer tasks
RADII = (1.0, 0.5, 0.25)  # of unit vectors, coarse to fine


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _net(apart: np.ndarray, among: np.ndarray, radius: float) -> np.ndarray:
    """For each of `among` the first chosen centre within the radius."""
    centre = np.full(len(apart), -1)
    free = np.zeros(len(apart), bool)
    free[among] = True
    for p in among:
        if free[p]:
            near = np.flatnonzero(free & (apart[p] <= radius))
            centre[near], free[near] = p, False
    return centre


def cover_tree(unit: np.ndarray) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
    """An order of the vectors in which every node is a range, and the levels: centre, radius, lo, hi, and the range of nodes below."""
    n = len(unit)
    apart = _distance(unit @ unit.T)
    above, at = [], np.arange(n)
    for radius in reversed(RADII):
        centre = _net(apart, np.unique(at), radius)
        at = centre[at]
        above.insert(0, at)
    order = np.lexsort((np.arange(n), *reversed(above)))
    levels = []
    for own in (a[order] for a in above):
        lo = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        hi = np.r_[lo[1:], n]
        far = apart[own, order]
        levels.append({"centre": own[lo], "radius": np.maximum.reduceat(far, lo) + 1e-12, "lo": lo, "hi": hi})
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for level, below in zip(levels, [*levels[1:], None], strict=True):
        level["centre"] = place[level["centre"]]
        first = below["lo"] if below else np.arange(n)
        level["below_lo"], level["below_hi"] = np.searchsorted(first, level["lo"]), np.searchsorted(first, level["hi"])
    return order, levels


def _opened(level_a: dict, level_b: dict, u: np.ndarray, v: np.ndarray, step: int = 1 << 17):
    """Pairs of the nodes below each pair (u, v), a bounded number at a time."""
    na, nb = level_a["below_hi"][u] - level_a["below_lo"][u], level_b["below_hi"][v] - level_b["below_lo"][v]
    ends = np.cumsum(na * nb)
    i = 0
    while i < len(u):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + step, "right")))
        counts = (na * nb)[i:j]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        width = np.repeat(nb[i:j], counts)
        yield np.repeat(level_a["below_lo"][u[i:j]], counts) + inside // width, np.repeat(level_b["below_lo"][v[i:j]], counts) + inside % width
        i = j


def _within_reach(x: np.ndarray, far_x: np.ndarray, y: np.ndarray, far_y: np.ndarray, step: int = 512):
    """Pairs of unit vectors no further apart than the sum of both distances, some at a time, with their exact distance.

    |x - y| <= p + q means that x.y + p*p/2 + p*q + q*q/2 >= 1, whose left side is one
    product of longer vectors. It is taken in single precision with its error allowed for;
    only pairs that pass are measured in double precision.
    """
    one = np.ones(len(y))
    left, right = np.c_[x, far_x**2 / 2, far_x, np.ones(len(x))].astype(np.float32), np.ascontiguousarray(np.c_[y, one, far_y, far_y**2 / 2].T.astype(np.float32))
    least = np.float32(1 - 1e-5 - 2e-6 * x.shape[1])
    for lo in range(0, len(x), step):
        u, v = np.divmod(np.flatnonzero(left[lo : lo + step] @ right >= least), len(y))
        u += lo
        for i in range(0, len(u), 1 << 16):
            p, q = u[i : i + (1 << 16)], v[i : i + (1 << 16)]
            yield p, q, _distance(np.einsum("ij,ij->i", x[p], y[q]))


def linked(a: tuple, b: tuple, cosine: float) -> np.ndarray:
    """Which vectors of tree a link with which of tree b. a, b: unit vectors in tree order, levels."""
    (x, ta), (y, tb) = a, b
    out = np.zeros((len(x), len(y)), bool)
    limit = float(_distance(np.array(cosine)))

    def visit(depth: int, u: np.ndarray, v: np.ndarray, apart: np.ndarray) -> None:
        la, lb = ta[depth], tb[depth]
        reach = la["radius"][u] + lb["radius"][v]
        keep = apart <= limit + reach + 1e-9
        u, v, apart, reach = u[keep], v[keep], apart[keep], reach[keep]
        whole = apart + reach <= limit - 1e-9
        for p, q in zip(u[whole], v[whole], strict=True):
            out[la["lo"][p] : la["hi"][p], lb["lo"][q] : lb["hi"][q]] = True
        for p, q in _opened(la, lb, u[~whole], v[~whole]):
            if depth + 1 < len(ta):
                visit(depth + 1, p, q, _distance(np.einsum("ij,ij->i", x[ta[depth + 1]["centre"][p]], y[tb[depth + 1]["centre"][q]])))
            else:
                near = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
                out[p[near], q[near]] = True

    pairs = [len(la["centre"]) * len(lb["centre"]) for la, lb in zip(ta, tb, strict=True)]
    depth = max(d for d, n in enumerate(pairs) if n <= 4 * pairs[0])  # wide nodes of a few vectors only would be opened against all others
    top_a, top_b = ta[depth], tb[depth]
    for u, v, apart in _within_reach(x[top_a["centre"]], limit + top_a["radius"], y[top_b["centre"]], top_b["radius"] + 1e-9):
        visit(depth, u, v, apart)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _build_job(table: pa.Table) -> pa.Table:
    column = table.column("vector").combine_chunks()
    flat = np.asarray(column.flatten())
    vectors = flat.reshape(len(table), -1)
    order, levels = cover_tree(_unit(vectors.astype(np.float64)))
    rep, many = np.asarray(table.column("rep"))[order], np.asarray(table.column("many"))[order]
    narrow = vectors.astype(np.float32)
    kept = narrow if (narrow == vectors).all() else vectors
    blob = pickle.dumps((kept[order], rep, many, levels))
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "tree": pa.array([blob], pa.large_binary()).cast(pa.binary())})


def _mates(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each of a and of b reaches by these links."""
    la, lb = a, b
    top = np.iinfo(np.int64).max
    while len(a):
        na = np.minimum(la, np.where(part, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(part, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return la, lb


def _pair(a: tuple, b: tuple, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks, or of one: vectors with links, their number, and each one's smallest mate."""
    (x, ra, ma, ta), (y, rb, mb, tb) = a, b
    link = linked((x, ta), (y, tb), cosine)
    if same:
        link |= link.T
        np.fill_diagonal(link, False)
    rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))  # most vectors have no link
    part = link[np.ix_(rows, cols)]
    back = np.zeros(len(cols), np.int64) if same else ma[rows] @ part
    return np.r_[ra[rows], rb[cols]], np.r_[part @ mb[cols], back], np.concatenate(_mates(part, ra[rows], rb[cols]))


def _tile_job(cosine: float):
    """All pairs of a block of one tile with a block of the other; if there is only one, all pairs in it."""

    def job(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        trees = {}
        for r, block in enumerate(blocks):
            vectors, *rest = pickle.loads(table.column("tree")[r].as_py())
            trees[block] = (_unit(vectors.astype(np.float64)), *rest)
        tiles = sorted({block // TILE for block in blocks})
        some = [_pair(trees[p], trees[q], cosine, p == q) for p in blocks for q in blocks if p // TILE == tiles[0] and q // TILE == tiles[-1] and (len(tiles) > 1 or p <= q)]
        return pa.table(dict(zip(("rep", "links", "mate"), map(np.concatenate, zip(*some, strict=True)), strict=True)))

    return job


def embedding_links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: `id_col`, n_links, component_id, kept."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    given = given.withColumn("vector", F.when(F.coalesce(good, F.lit(False)), F.transform("vector", lambda v: v + 0.0)))
    distinct = written(given.filter("vector is not null").groupBy("vector").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("rep"), F.count("*").alias("many")).withColumn("dim", F.size("vector")))
    distinct = distinct.withColumn("key", F.xxhash64("vector"))  # ids may repeat over different vectors
    sizes = distinct.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumn("tiles", F.ceil(F.col("blocks") / TILE).cast("int"))
    most = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups weigh little and take long, so they are dealt by their number; joins by `dim` alone would leave all in one task
    building, pairing = (min(most, int(n or 1)) for n in sizes.agg(F.sum("blocks"), F.sum(F.expr("tiles * (tiles + 1L) div 2"))).first())
    dealt = distinct.join(sizes, "dim").withColumn("block", F.pmod(F.col("key"), F.col("blocks")).cast("int")).repartition(building, "dim", "block")
    trees = written(dealt.select("dim", "block", F.col("key").alias("rep"), "many", "vector").groupBy("dim", "block").applyInArrow(_build_job, "dim int, block int, tree binary"))
    tiles = trees.join(sizes, "dim").withColumn("tile", F.expr(f"block div {TILE}")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("dim", "block", "tree", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))
    found = written(tiles.repartition(pairing, "dim", "p", "q").groupBy("dim", "p", "q").applyInArrow(_tile_job(cosine), "rep long, links long, mate long"))
    counts = found.groupBy(F.col("rep").alias("key")).agg(F.sum("links").alias("links"))
    reached = components(found.filter("mate <> rep").select(F.col("rep").alias("a"), F.col("mate").alias("b")))
    named = distinct.select("vector", "key", "rep", "many").join(reached.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = named.join(least, "component").join(counts, "key", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = given.join(told, "vector", "left")
    named_id = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.when(F.col("component_id") != -(2**63), F.col("component_id")))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), named_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_embedding_links": op7_embedding_links}
SQL: dict[str, str] = {}
