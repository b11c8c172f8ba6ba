import inspect
import re
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import lm_score as m


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    p = {k: r.normal(size=s) * 0.3 for k, s in m.SHAPES.items()}
    before = r.random((2, m.NEW, m.CLASSES))
    x = r.integers(0, m.INPUTS, (2, m.SPAN))
    x[0, : m.CONTEXT] = m.PAD
    c = r.integers(-1, m.CLASSES, (2, m.NEW))

    def loss():
        *_, w, total = m.forward(p, before, x)
        said = np.log(np.take_along_axis(w, np.maximum(c, 0)[..., None], -1)[..., 0] / total)
        return -(said * (c >= 0)).sum() / (c >= 0).sum()

    for k, g in m.gradients(p, before, x, c).items():
        flat, at = p[k].reshape(-1), int(np.abs(g).argmax())
        keep = flat[at]
        flat[at] = keep + 1e-5
        up = loss()
        flat[at] = keep - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g.reshape(-1)[at], rel=1e-3), k
        flat[at] = keep


def test_base_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 1, "")], "doc_id long, text string"))
    rows = {x.doc_id: x for x in m.lm_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), block_bytes=40_000).collect()}
    counts, texts = Counter(), {d.doc_id: re.findall(r"[^\x20\x09-\x0D]+", d.text or "") for d in docs.collect()}
    for d in docs.collect():
        if zlib.crc32(str(d.doc_id).encode()) % 5 != 1:
            counts.update([*texts[d.doc_id], None])
    n, v = sum(counts.values()), len(counts)
    for i, words in texts.items():
        want = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, None])
        x = rows[i]
        assert x.base_score == pytest.approx(want, rel=1e-9) and (x.n_tokens, x.train_tokens) == (len(words) + 1, n)
        assert x.n_known == sum(counts[w] > 0 for w in [*words, None]) and x.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    assert all(x.score < 0 for x in rows.values())


def test_query_lower_cases_a_to_z_only(spark, tmp_path):
    texts = ["The THE the cat", "ÉTÉ été Cat", "Zebra zEBRA [@`{", None, *["a Word Or two"] * 8]
    low = [t and re.sub("[A-Z]", lambda c: chr(ord(c[0]) + 32), t) for t in texts]
    assert low[1] == "ÉtÉ été cat"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in m.op6_lm_scores(spark, str(tmp_path)).collect()}
    words, counts = [[*re.findall(r"[^\x20\x09-\x0D]+", t or ""), None] for t in low], Counter()
    for i, w in enumerate(words):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for i, w in enumerate(words):
        assert rows[i].base_score == pytest.approx(sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9), texts[i]
        assert (rows[i].n_known, rows[i].train_tokens) == (sum(counts[x] > 0 for x in w), n)
    spark.createDataFrame(list(enumerate(low)), "doc_id long, text string").write.parquet(f"{tmp_path}/low/documents.parquet")
    assert {x.doc_id: x.score for x in m.op6_lm_scores(spark, f"{tmp_path}/low").collect()} == pytest.approx({i: x.score for i, x in rows.items()}, rel=1e-6)


def test_query_trains_on_every_window():
    rounds = inspect.signature(m.lm_scores).parameters["rounds"].default
    r = np.random.default_rng(8)
    marks, number = r.integers(0, 2**63, 5000).astype(np.uint64), r.integers(0, 400, 5000)
    for n in (1, rounds, 5):
        turns = [m.in_turn(marks, number, n, k).tolist() for k in range(n)]
        assert sorted(x for t in turns for x in t) == list(range(5000)) and all(turns)


def test_held_out_texts_are_likelier_than_by_the_base(spark, sf):
    held = m.op6_lm_scores(spark, sf).filter("held_out").collect()
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def corpus_of(ids, size=300):
    about = m.Symbols(np.bincount(ids, minlength=size))
    two, last, own = about.neighbours(ids, np.array([0, len(ids)]))
    pairs = np.zeros((m.INPUTS + 1, m.INPUTS))
    np.add.at(pairs, (last, own), 1)
    corpus = m.Corpus(about, pairs)
    cells, n = np.unique(m.buckets(two, last) * m.CLASSES + corpus.cls[own], return_counts=True)
    corpus.add(cells, n)
    votes = m.Votes(size)
    votes.add(ids, np.array([0, len(ids)]))
    at = np.flatnonzero(votes.cast)
    corpus.vote(at, votes.id[at], votes.left[at], votes.cast[at])
    return corpus


def test_guesses_against_brute_force():
    r = np.random.default_rng(6)
    phrase = r.integers(0, 4, 9)
    texts = [np.concatenate([r.integers(0, 4, k), phrase, r.integers(0, 4, 5), phrase]) if k else np.zeros(0, np.int64) for k in r.integers(0, 6, 40)]
    ids, ends = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    votes, follows = m.Votes(300), {}
    votes.add(ids, ends)
    got, cue = m.recent(ids, ends, text), m.rows_of(m.cues(ids, ends, m.CUE))
    for t, own in enumerate(texts):
        last = {}
        for i, x in enumerate(own.tolist()):
            key = tuple(own[max(0, i - m.RECENT) : i])
            assert got[ends[t] + i] == last.get(key, -1)
            last[key] = x
            follows.setdefault(tuple(own[max(0, i - m.CUE) : i].tolist()), []).append((x, cue[ends[t] + i]))
    for seen in follows.values():
        n = Counter(x for x, _ in seen)
        row, top = seen[0][1], min(n, key=lambda x: (-n[x], x))
        assert {c for _, c in seen} == {row} and (votes.id[row], votes.left[row], votes.cast[row]) == (top, n[top], len(seen))
    again = m.Votes(300)  # votes of two readings: what is left never exceeds the id's own
    for a in (0, 20):
        again.add(ids[ends[a] : ends[a + 20]], ends[a : a + 21] - ends[a])
    for seen in follows.values():
        n, row = Counter(x for x, _ in seen), seen[0][1]
        assert again.cast[row] == len(seen) and again.left[row] <= n[again.id[row]]
    said, kind = np.log10(r.random(len(ids))), r.integers(0, 4, len(ids))
    out, state = m.with_guesses(said, ids, ends, text, got, kind), {}
    for i in range(len(ids)):
        if i == ends[text[i]]:
            state, row = {}, 0
        want = 10 ** said[i]
        if got[i] >= 0:
            k = (kind[i], (row > 0) + (row > 2) + (row > 7))
            hits, n = state.get(k, (0, 0))
            share = (hits + m.TRUST * m.RIGHT[k[1]]) / (n + m.TRUST)
            want = share * (got[i] == ids[i]) + (1 - share) * want
            state[k] = hits + (got[i] == ids[i]), n + 1
        row = row + 1 if got[i] == ids[i] else 0
        assert out[i] == pytest.approx(np.log10(want), rel=1e-9)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    text, size = r.integers(0, 2500, 70), 2600
    corpus = corpus_of(r.integers(0, 2500, 9000), size)
    p = m.start()
    p["out"] = r.normal(size=p["out"].shape).astype(np.float32)
    for n in (0, 1, 40, 69):  # all texts that differ in their last id
        before = m.log10_scores(p, corpus, text[:n], np.array([0, n]))[0] if n else 0
        ids = np.c_[np.tile(text[:n], (size, 1)), np.arange(size)].ravel()
        each = m.log10_scores(p, corpus, ids, np.arange(size + 1) * (n + 1))
        assert (10 ** (each - before)).sum() == pytest.approx(1, abs=1e-3)


def test_training_lowers_the_loss():
    r = np.random.default_rng(3)
    ids = np.concatenate([np.r_[a, b] for a, b in zip(r.integers(0, 60, 1500), r.integers(60, 120, 1500))])
    ids[4::2] = ids[0:-4:2] + 0  # what comes next depends on what stood four before
    corpus = corpus_of(ids)
    ends = np.array([0, len(ids)])
    x, y, *_ = m.windows(corpus.symbol, ids, ends)
    c = np.where(y >= 0, corpus.cls[corpus.symbol[ids[np.maximum(y, 0)]]], -1)
    p = m.start()
    q, _ = m.train(p, ((x, corpus.before(x), c) for _ in range(60)))
    assert m.log10_scores(q, corpus, ids, ends)[0] > 0.95 * m.log10_scores(p, corpus, ids, ends)[0]  # counts after two symbols know most of these ids already


def test_words_are_encoded_alike_alone_and_together():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, _ = m.coder(path)
    words = [w.encode() for w in ["it's", "été", "\u00a0", "\u00a0\u00a0a", "12ab", "<|endoftext|>", "x\u3000", "\u3000y", "z" * 3000, "…!?"]]
    for some in (words, words[:2], words[4:6], []):
        ids, first = m.encode(some, path)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [enc.encode_ordinary(" " + w.decode()) for w in some]


def test_neighbours_stop_at_texts_and_means_are_weighted():
    about = m.Symbols(np.bincount([0, 0, 0, 1, 1, 2]))
    two, last, own = about.neighbours(np.array([0, 1, 2, 1, 0, 0]), np.array([0, 3, 3, 4, 6]))
    assert own.tolist() == [0, 1, 2, 1, 0, 0] and last.tolist() == [m.PAD, 0, 1, m.PAD, m.PAD, 0] and two.tolist() == [m.PAD, m.PAD, 0, m.PAD, m.PAD, m.PAD]
    rows = pa.table({"weights": pa.array([np.float32([1, 2]).tobytes(), np.float32([5, 0]).tobytes()], pa.binary()), "tokens": [3, 1]})
    assert np.frombuffer(m._mean(rows).column("weights")[0].as_py(), np.float32).tolist() == [2, 1.5]


def test_each_token_is_scored_once_and_an_empty_table(spark):
    ids = np.random.default_rng(1).integers(0, 300, 205)
    corpus = corpus_of(ids)
    _, y, *_ = m.windows(corpus.symbol, ids, np.array([0, 1, 33, 97, 205]))
    assert sorted(y[y >= 0].tolist()) == list(range(205))
    p = m.start()
    whole = m.log10_scores(p, corpus, ids, np.array([0, 205]))
    x = m.windows(corpus.symbol, ids, np.array([0, 205]))[0]
    assert np.isfinite(whole).all() and np.isfinite(m.forward(p, corpus.before(x), x)[-1]).all()
    assert m.lm_scores(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect() == []


def blocks_of(texts, held):
    """One block of texts of ids, in which each id is a word of its own; ids as `_texts` reads them."""
    words, at = np.unique(np.concatenate(texts), return_inverse=True)
    planes = lambda x: np.ascontiguousarray(np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
    own = ~np.repeat(held, [len(t) for t in texts])
    return pa.RecordBatch.from_pydict({"held": [held], "sizes": [np.array([len(t) for t in texts]).tobytes()], "words": [planes(at)], "n": [np.bincount(at[own], minlength=len(words)).tobytes()], "ids": [planes(words)], "many": [planes(np.ones(len(words)))]})


def test_counts_and_votes_of_tasks_travel_as_slices():
    r = np.random.default_rng(9)
    size, tasks = 3 * m.SLICE, [[r.integers(0, 3 * m.SLICE, n) for n in (9000, 1, 4000)] + [r.integers(0, 3, 5000)] for _ in range(3)]
    held = [False, True, False, False]
    learned = [t for texts in tasks for t, h in zip(texts, held) if not h]
    want = np.bincount(np.concatenate(learned), minlength=size)
    for job in (m._tally_job(size, lambda ids, ends: ids), m._id_job(size)):
        rows = [x for texts in tasks for x in job(iter([blocks_of(texts, held)]))]
        assert sum(map(len, rows)) == 9  # and not one for each of some 30,000 counts
        got = np.zeros(size, np.int64)
        for x in m._sum_job(iter(rows)):
            got[m._cells(x["part"][0].as_py(), x["cell"][0])] += np.frombuffer(x["n"][0].as_py(), np.int64)
        assert (got == want).all()
    rows, cast = [x for texts in tasks for x in m._vote_job(size)(iter([blocks_of(texts, held)]))], Counter()
    for x in rows:
        cells = m._cells(x["part"][0].as_py(), x["cell"][0])
        for row, own, left, n in zip(cells.tolist(), *(np.frombuffer(x[c][0].as_py(), np.int32).tolist() for c in ("own", "left", "cast"))):
            cast[row, own] += 0
            cast[row, own, "left"] += left
            cast[row] += n
    best = {}
    for row, own in (k for k in cast if isinstance(k, tuple) and len(k) == 2):
        best[row] = min(best.get(row, (1, 0)), (-cast[row, own, "left"], own))
    assert sum(cast[k] for k in best) == sum(map(len, learned)) and sum(map(len, rows)) <= 3 * m.GUESSES // m.SLICE
    got = {}
    for x in m._lead_job(size)(iter(rows)):
        cells = m._cells(x["part"][0].as_py(), x["cell"][0])
        got |= {row: rest for row, *rest in zip(cells.tolist(), *(np.frombuffer(x[c][0].as_py(), np.int64).tolist() for c in ("own", "left", "cast")))}
    assert got == {row: [own, -left, cast[row]] for row, (left, own) in best.items()}


def test_words_are_spelt_from_their_places():
    data = np.frombuffer(b"one two three", np.uint8)
    text, begins = m.spelt(data, np.array([4, 0, 0, 8]), np.array([7, 0, 3, 13]))
    assert text == b" two  one three" and begins.tolist() == [0, 4, 5, 9, 15]
    assert m.spelt(data[:0], np.array([0]), np.array([0]))[0] == b" "


def test_words_of_blocks_are_counted_by_slices():
    r = np.random.default_rng(11)
    blocks = [(np.unique(r.integers(-40, 40, 30) * 10**15), part) for part in (3, 9, 12)]
    blocks = [(t, r.integers(0, 3, len(t)), part) for t, part in blocks]
    batch = pa.RecordBatch.from_pydict({"part": [p for *_, p in blocks], "tokens": [t.tobytes() for t, *_ in blocks], "n": [n.tobytes() for _, n, _ in blocks]})
    rows = pa.Table.from_batches(m._word_job(4)(iter([batch])))
    assert len(rows) <= 12  # and not one for each word
    total, held, got, told = Counter(), Counter(), {}, [0, 0]
    for t, n, _ in blocks:
        total.update(dict(zip(t.tolist(), n.tolist())))
        held.update(t.tolist())
    for k in range(4):
        own = rows.filter(pa.compute.equal(rows["slice"], k))
        out = m.shared_words(own) if len(own) else own.slice(0, 0)
        for x in out.to_pylist():
            told = [told[0] + x["all"], told[1] + x["kinds"]]
            got.setdefault(x["part"], {}).update(zip(*(np.frombuffer(x[c], np.int64).tolist() for c in ("tokens", "totals"))))
    assert told == [sum(total.values()), sum(n > 0 for n in total.values())]
    assert got == {part: {t: total[t] for t in tokens.tolist() if held[t] > 1} for tokens, _, part in blocks}


def test_only_chosen_windows_are_made():
    ids, ends = np.random.default_rng(12).integers(0, 300, 500), np.array([0, 0, 7, 300, 500])
    symbol, keep = np.arange(300), np.array([0, 2, 5, 11])
    every, some = m.windows(symbol, ids, ends), m.windows(symbol, ids, ends, lambda text, number: keep)
    assert all((a[keep] == b).all() for a, b in zip(every, some, strict=True))


def test_words_of_earlier_blocks_are_not_encoded_again(monkeypatch):
    path, sent, plain = public_tokenizers.path("byte_bpe_50k.tiktoken"), [], m.encoded
    monkeypatch.setattr(m, "encoded", lambda text, *rest: sent.append(text) or plain(text, *rest))
    monkeypatch.setattr(m.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    texts = ["aa été bbbb aa été", "once  été aa aa twice twice", "", "twice aa new", "new twice été"]
    batch = pa.RecordBatch.from_pydict({"id": range(5), "text": texts, "held": [False] * 5})

    def made():
        out = []
        for row in (x for k in range(5) for x in m._encode_job(path, 1, False)(iter([batch.slice(k, 1)]))):
            *_, ids, ends = next(m._texts(row, False))
            out.append((ids.tolist(), ends.tolist()))
        return out

    m._met.cache_clear()
    first = made()
    end = m.coder(path)[1]
    assert [x for x, _ in first] == [[*(i for w in t.split() for i in m.coder(path)[0].encode_ordinary(" " + w)), end] for t in texts]
    assert b"".join(sent).decode().split() == ["aa", "été", "bbbb", "twice", "once", "new", "new"]  # words that a block has once are not kept
    sent.clear()
    assert made() == first and not {"aa", "été", "twice"} & set(b"".join(sent).decode().split())


def test_counting_holds_one_table_of_cells():
    ids, cells = np.random.default_rng(3).integers(0, 1 << 22, 1 << 21), 1 << 22
    block = blocks_of([ids], [False])
    tracemalloc.start()
    rows = list(m._tally_job(cells, lambda ids, ends: ids)(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(np.frombuffer(x["n"][0].as_py(), np.int32).sum() for x in rows) == len(ids)
    assert peak < 120 << 20


def test_attention_is_that_of_queries_keys_and_values():
    r = np.random.default_rng(4)
    p = {k: r.normal(size=s) * 0.5 for k, s in m.SHAPES.items()}
    before, x = r.random((3, m.NEW, m.CLASSES)), r.integers(0, m.INPUTS, (3, m.SPAN))
    *_, w, total = m.forward(p, before, x)
    for b in range(3):
        e = p["embed"][x[b]] + p["place"]
        for i in range(m.NEW):
            some = e[: m.CONTEXT + i + 1]
            s = np.exp(some @ p["key"] @ (some[-1] @ p["query"]) * m.WIDTH**-0.5)
            want = before[b, i] * np.exp((s @ (some @ p["value"]) / s.sum() + some[-1]) @ p["out"])
            assert w[b, i] / total[b, i] == pytest.approx(want / want.sum(), rel=1e-6)


def test_leaders_of_many_tasks_meet_in_slices_that_fit(spark, tmp_path, monkeypatch):
    most, r, size, plain = 1 << 16, np.random.default_rng(13), 50_000, m._lead_job
    monkeypatch.setattr(m, "LED", most, raising=False)

    def counted(*args):
        job = plain(*args)

        def run(batches):
            batches = list(batches)
            (tmp_path / str(m.TaskContext.get().partitionId())).write_text(str(sum(len(x.as_py()) // 2 for b in batches for x in b.column("cell"))))
            return job(iter(batches))

        return run

    tasks = [blocks_of([r.integers(0, size, 30_000)], [False]) for _ in range(6)]
    blocks = spark.range(0, 6, 1, 6).mapInArrow(lambda rows: (tasks[x["id"][0].as_py()] for x in rows), "held array<boolean>, sizes binary, words binary, n binary, ids binary, many binary")
    monkeypatch.setattr(m, "_lead_job", counted)
    got = m._voted(blocks, size)
    read = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert max(read) <= most < sum(read)
    rows = [x for b in tasks for x in m._vote_job(size)(iter([b]))]
    want = {}
    for x in plain(size)(iter(rows)):
        cells = m._cells(x["part"][0].as_py(), x["cell"][0])
        want |= dict(zip(cells.tolist(), zip(*(np.frombuffer(x[c][0].as_py(), np.int64).tolist() for c in ("own", "left", "cast")), strict=True), strict=True))
    assert dict(zip(got[0].tolist(), zip(*(x.tolist() for x in got[1:]), strict=True), strict=True)) == want


def test_slices_hold_what_their_tasks_may_lead_with():
    for tasks in (0, 1, 16, 17, 480, 2400, 10**7):
        cut = m.cut_for(tasks)
        assert m.GUESSES % cut == 0 and 1 <= cut <= m.SLICE and (cut * tasks <= m.LED or cut == 1)
