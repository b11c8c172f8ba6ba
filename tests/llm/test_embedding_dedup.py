import numpy as np

from tessera.llm import embedding_dedup as module
from tessera.llm.embedding_dedup import embedding_links


def brute(rows, cosine):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v) / np.linalg.norm(v)
    links = {k: [j for j in good if j != k and k in good and len(good[j]) == len(good[k]) and good[j] @ good[k] >= cosine] for k in range(len(rows))}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((i, len(links[k]), least, i == least))
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for family in range(25):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 25)):
            rows.append((len(rows), (base + r.normal(size=8) * r.choice([0.0, 0.1, 0.25, 0.5])).tolist()))
    rows += [(len(rows) + k, v) for k, v in enumerate([None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-200, 0.0], rows[0][1], rows[0][1]])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, kept int")
    for block in (40, 4000):
        got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_links(table, 0.9, block=block).collect())
        assert got == brute(rows, 0.9)
    assert embedding_links(table.limit(0)).collect() == []


def tree_of(vectors):
    unit = module._unit(vectors)
    order, levels = module.cover_tree(unit)
    return unit[order], levels


def test_links_of_two_trees_are_those_of_brute_force():
    r = np.random.default_rng(5)
    wide, narrow = r.normal(size=(300, 16)), r.normal(size=16) + r.normal(size=(200, 16)) * 0.3
    families = np.concatenate([r.normal(size=16) + r.normal(size=(60, 16)) * k for k in (0.02, 0.1, 0.2, 0.35)])
    for a, b in ((wide, wide[::-1]), (families, families + 0.01), (narrow, wide), (families, np.r_[narrow, wide, families[:9]]), (families[:1], narrow)):
        (x, ta), (y, tb) = a, b = tree_of(a), tree_of(b)
        near = x @ y.T
        sure = abs(near - 0.9) > 1e-12
        assert (module.linked(a, b, 0.9) == (near >= 0.9))[sure].all()


def test_pairs_at_the_limit_of_reach_pass(monkeypatch):
    r = np.random.default_rng(6)
    x = module._unit(r.normal(size=(400, 64)))
    y = module._unit(x + r.normal(size=x.shape) * 0.06)
    apart = np.sqrt(((x - y) ** 2).sum(1))
    far = r.random(400) * apart  # what is left of each pair's distance is the other's: equal but for rounding
    got = {(p, q) for u, v, d in module._within_reach(x, far, y, apart - far + 1e-9, 100) for p, q in zip(u.tolist(), v.tolist())}
    assert {(k, k) for k in range(400)} <= got
    opened, own = [], module._opened
    monkeypatch.setattr(module, "_opened", lambda la, lb, u, v: opened.append(len(u)) or own(la, lb, u, v))
    wide, pair = r.normal(size=(500, 64)), r.normal(size=64) + r.normal(size=(40, 64)) * 0.6
    a, b = tree_of(np.r_[wide, pair]), tree_of(np.r_[r.normal(size=(500, 64)), pair])
    assert module.linked(a, b, 0.9).sum() >= 40 and sum(opened) < 3000  # and not some wide nodes against all others


def test_blocks_and_pairs_of_one_length_are_dealt_to_several_tasks(spark, tmp_path):
    def where(job):
        def run(table):
            from pyspark import TaskContext

            (tmp_path / f"{job.__name__}-{TaskContext.get().partitionId()}").touch()
            return job(table)

        return run

    r = np.random.default_rng(8)
    table = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(700)], "vec_id long, embedding array<double>")
    build, tile = module._build_job, module._tile_job
    build.__name__, seen = "build", []
    try:
        module._build_job, module._tile_job = where(build), lambda cosine: where(tile(cosine))
        got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_links(table, 0.9, block=30).collect())
    finally:
        module._build_job, module._tile_job = build, tile
        build.__name__ = "_build_job"
    seen = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert seen.count("build") > 1 and seen.count("job") > 1
    assert got == brute([(x.vec_id, x.embedding) for x in table.collect()], 0.9)
