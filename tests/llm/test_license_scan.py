import re
import textwrap
from itertools import combinations
from math import exp

from tessera.llm.license_scan import TEMPLATES, UNKNOWN, bound, license_scan


def test_statements_are_found_and_clean_texts_left_alone(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(-1, None), (-2, ""), (-3, "A licence to be under the version of the work.\nPublic terms."), (-3, "MIT is a school")]
    want = {i: () for i, _ in rows}
    for k, (family, texts) in enumerate(sorted(TEMPLATES.items())):
        for j, t in enumerate(texts):
            i = -100 - 10 * k - j
            rows.append((i, f"Some words before\n  {t.upper()} \nand after"))
            want[i] = (family,)
    docs = real.union(spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string"))
    got = license_scan(docs).collect()
    by = {r.doc_id: tuple(r.licences) for r in got}
    assert len(got) == docs.count() and {i: by[i] for i in want} == want
    for r in real.collect():  # held against plain search for the four statements that these texts use
        plain = {f for f in ("apache-2.0", "mit", "gpl", "cc-by-nc") if any(re.search(re.escape(t.rstrip(".")), r.text) for t in TEMPLATES[f][:1])}
        assert set(by[r.doc_id]) == plain, r.doc_id
    assert license_scan(docs.limit(0)).collect() == []


def test_paragraphs_below_the_bound_are_unlikely():
    zero = [0.0] * (UNKNOWN + 1)
    weights = {g: [*zero[:k], gain, *zero[k + 1 :]] for g, k, gain in [("a", 0, 3.0), ("b", 1, 1.0), ("c", 0, 0.7), ("d", UNKNOWN, 2.0), ("e", 2, 0.2)]}
    intercepts = [-3.0] * UNKNOWN + [2.0]
    for least in (0.05, 0.2, 0.5, 0.9):
        gains, lead = bound(weights, intercepts, least)
        assert set(gains) == {"a", "b", "c", "e"}
        for n in range(len(weights) + 1):
            for some in combinations(weights, n):
                z = [b + sum(weights[g][c] for g in some) for c, b in enumerate(intercepts)]
                likely = 1 - exp(z[UNKNOWN]) / sum(map(exp, z)) >= least
                assert not likely or sum(gains.get(g, 0) for g in some) >= lead
    assert bound(weights, [0.0] * (UNKNOWN + 1), 0.5)[1] <= 0


def test_wrapped_statements_are_found(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows, want = [], {}
    for k, (family, t) in enumerate((f, TEMPLATES[f][1]) for f in ("mit", "bsd", "gpl")):
        for j, (width, mark) in enumerate([(80, ""), (72, "# "), (60, " * "), (40, "")]):
            i = -100 - 10 * k - j
            rows.append((i, "\n".join(["Some words before", "", *(mark + x for x in textwrap.wrap(t, width)), "", "and after"])))
            want[i] = (family,), 1
    rows.append((-1, TEMPLATES["mit"][1].replace(" of charge", "\n\nof charge\n\n").replace("software", "\n\nsoftware\n\n")[:70]))
    want[-1] = (), 0
    got = {r.doc_id: r for r in license_scan(real.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {i: (tuple(got[i].licences), got[i].n_found) for i in want} == want


def test_near_families_are_told_apart(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [
        (-1, "SPDX-License-Identifier: ISC", ("isc",)),
        (-2, "SPDX-License-Identifier: Zlib", ()),
        (-3, "This work is licensed under the GNU Lesser General Public License, version 2.1.", ("lgpl",)),
        (-4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lgpl",)),
        (-5, "All rights reserved. No part of this work may be used under a license.", ()),
        (-6, "Licensed under CC BY-SA 4.0.", ("cc-by-sa",)),
    ]
    docs = real.union(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"))
    # a clashing column of the same names as the operator's own
    got = {r.doc_id: tuple(r.licences) for r in license_scan(docs.selectExpr("*", "1 as id", "2 as mark", "3 as gram")).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: w for i, _, w in rows}


def test_what_only_looks_like_a_statement_is_not_confirmed(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    no = [
        "The school of MIT was released under the rain.", "Released under the EUPL License with MIT staff.", "SPDX-License-Identifier: MIT-0", "This work is not licensed under the Apache License, Version 2.0.", "Apache License, Version 1.1",
        "Mozilla Public License 1.1", "CC BY-NC-SA 4.0", "Licensed under CC BY-NC-SA 4.0.", "Attribution-NonCommercial-NoDerivatives 4.0", "BSD", "A licence of the general public.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Our staff at MIT released under the new License.", "This module is not released under the MIT License.",
    ]
    yes = {"SPDX-License-Identifier: GPL-2.0-only": "gpl", "# SPDX-License-Identifier: MIT": "mit", "Our code is released under the MIT License, as before.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "SPDX-License-Identifier: BSD-3-Clause": "bsd"}
    rows = [(-k, t) for k, t in enumerate([*no, *yes], 1)]
    got = {r.doc_id: r for r in license_scan(real.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    wrong = [(t, got[-k].licences) for k, t in enumerate(no, 1) if got[-k].licences] + [(t, got[-k].licences) for k, t in enumerate(yes, len(no) + 1) if got[-k].licences != [yes[t]]]
    assert not wrong
    assert all(got[-k].best >= 0.5 for k in range(len(no) + 1, len(rows) + 1))
