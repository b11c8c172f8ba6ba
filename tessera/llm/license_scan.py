"""Licence scans by a trained paragraph classifier (operator 10), in DataFrame functions only.

Paragraphs are lines, and runs of 2 to `RUN` lines without a blank one between (statements
that are wrapped); both are sets of word n-grams. A sparse multinomial logistic regression,
fitted by Spark ML on licence statements and on paragraphs of a bounded sample of the
texts as unknowns, gives each n-gram its weights. How far an n-gram can lift a paragraph
over the unknown class follows from these (`bound`): lines whose n-grams can't lift it
far enough are decided where they are read, and the n-grams of the others are joined with
the table of weights, whose size `features` bounds. Statements of other licences, denials
and prose about them are of the unknown class too. Scores are divided by a temperature
that rows of all classes held out from the fit give, and a family counts if it is likelier than all
else together. What the model names is then compared with the family's templates, in order,
by pairs of words, and confirmed if the paragraph holds enough of one and a word that
sets the family apart (`MARKS`). Runs are only
looked at about lines with a part of such a word and where the lines around hold enough of
a template; of confirmed paragraphs that overlap the shortest and first counts.

Defined cases: a null or empty text has no paragraphs; a paragraph of any length is
taken whole; repeated rows get equal results, each its own row; a table without texts is
scanned with unknowns left out; other columns are ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

# Families and statements by which works name them.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
# Statements of other licences, denials, and prose with words of licences; all are of the unknown class.
OTHERS = [
    "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: 0BSD", "SPDX-License-Identifier: Apache-1.1", "SPDX-License-Identifier: Apache-1.0", "SPDX-License-Identifier: MPL-1.1", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "SPDX-License-Identifier: GFDL-1.3-only", "SPDX-License-Identifier: Unlicense",
    "Released under the MIT-0 License.", "Released under the MIT No Attribution License.", "Licensed under the Apache License, Version 1.1.", "Licensed under the Apache License, Version 1.0.", "Released under the Mozilla Public License 1.1.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Licensed under the European Union Public License, version 1.2.", "Released under the EUPL License.", "Released under the zlib License.",
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC0 1.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This work is not licensed under the Apache License, Version 2.0.", "Not licensed under the Apache License, Version 2.0.", "This work is not released under the MIT License.", "Not released under the BSD 3-Clause License.",
    "This work is not licensed under the GNU General Public License, version 3.", "This work is no longer licensed under CC BY 4.0.", "Never licensed under CC BY-NC 4.0.",
    "A report was released under the name of a student at MIT.", "The work of the school was licensed under a new name.", "All rights reserved.", "The Apache helicopter was released under a new version.", "The general public was free to use the software.", "Mozilla released a new version of the software.",
]
# Words and pairs of which a statement of a family must hold one.
MARKS = {
    "agpl": ["affero", "agpl"],
    "apache-2.0": ["apache"],
    "bsd": ["bsd", "binary forms"],
    "cc-by": ["attribution 4", "by 4"],
    "cc-by-nc": ["attribution noncommercial", "by nc"],
    "cc-by-sa": ["attribution sharealike", "by sa"],
    "gpl": ["gnu general", "identifier gpl"],
    "isc": ["isc", "without fee"],
    "lgpl": ["lesser", "lgpl"],
    "mit": ["mit", "of charge"],
    "mpl-2.0": ["mozilla", "mpl"],
}
# A rarer word of each of these.
RARE = ["affero", "agpl", "apache", "bsd", "binary", "attribution", "4", "nc", "sa", "gnu", "gpl", "isc", "fee", "lesser", "lgpl", "mit", "charge", "mozilla", "mpl"]
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
RUN = 6  # lines: the longest template at 30 columns


def ngrams(text: Column) -> Column:
    """Distinct words and word pairs of a paragraph, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def both(ws: Column) -> Column:
        pairs = F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(F.get(ws, i), F.lit(" "), w))
        return F.array_distinct(F.concat(ws, pairs))

    return F.get(F.transform(F.array(words), both), 0)  # one element, so that the words are split once and not again for each pair


def _statements(spark: SparkSession) -> DataFrame:
    """(label, text, weight, held): every template and other statement, whole, inside a sentence, and with a sixth of its words left out in six ways; some of these are held out of the fit."""
    rows = [(FAMILIES.index(f), t) for f in FAMILIES for t in TEMPLATES[f]] + [(UNKNOWN, t) for t in OTHERS]
    made = [(c, t, False) for c, t in rows]
    made += [(c, f"{before} {t}", k == 2) for c, t in rows for k, before in enumerate(("Note:", "Copyright the authors.", "All of this:"))]
    made += [(c, " ".join(w for k, w in enumerate(t.split()) if k % 6 != r), r == 5) for c, t in rows if c != UNKNOWN for r in range(6) if len(t.split()) > 8]
    return spark.createDataFrame(made, "label int, text string, held boolean").select("label", "text", F.lit(4.0).alias("weight"), "held")


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def around(lines: Column, i: Column) -> Column:
    """All lines that runs with the i-th hold, as one text."""
    lo = F.greatest(i - (RUN - 1), F.lit(0))
    return F.array_join(F.slice(lines, lo + 1, i - lo + RUN), "\n")


def template_grams(spark: SparkSession) -> list[list[str]]:
    """N-grams of each template, in the order of families."""
    rows = [(k, t) for k, t in enumerate(t for f in FAMILIES for t in TEMPLATES[f])]
    return [r.grams for r in spark.createDataFrame(rows, "k int, text string").select("k", ngrams(F.col("text")).alias("grams")).orderBy("k").collect()]


def listed(grams: list[str]) -> Column:
    """An array that is folded to a constant; n-grams have no line ends."""
    return F.split(F.lit("\n".join(grams)), "\n") if grams else F.array().cast("array<string>")


def holds(grams: Column, share: float, templates: list[list[str]]) -> Column:
    """Do n-grams hold a share of any template's? Those of no template are left out first, once."""
    def any_of(few: Column) -> Column:
        first, *rest = [F.size(F.array_intersect(few, listed(own))) >= share * len(own) for own in sorted(templates, key=len)]
        for x in rest:
            first |= x
        return first

    return F.exists(F.array(F.array_intersect(grams, listed(sorted({g for own in templates for g in own})))), any_of)


def unit(lines: Column, a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), F.array_join(F.slice(lines, a + 1, b - a + 1), "\n").alias("line"))


def runs_at(lines: Column, i: Column, overlap: float, templates: list[list[str]]) -> Column:
    """Array of (a, b, line): the runs of lines a to b with the i-th, if those around hold enough of a template."""
    one = lambda a, b: unit(lines, a, b)
    ends = lambda a: F.transform(F.sequence(i, F.least(F.size(lines) - 1, a + (RUN - 1))), lambda b: one(a, b))
    runs = F.flatten(F.transform(F.sequence(F.greatest(i - (RUN - 1), F.lit(0)), i), ends))
    runs = F.filter(runs, lambda u: (u["a"] < u["b"]) & ~F.rlike(u["line"], F.lit(r"\n[ \t\r]*\n")))
    near = F.get(F.filter(F.array(ngrams(around(lines, i))), lambda g: holds(g, overlap, templates)), 0)  # the n-grams are made once
    return F.when(near.isNotNull(), runs).otherwise(F.slice(runs, 1, 0))


def fit(docs: DataFrame, sample: int, features: int, templates: list[list[str]]) -> tuple[list[tuple], list[float]]:
    """Calibrated weights of n-grams [(n-gram, [weight of each class])] and intercepts. Fitted on statements of all families and others, and on the lines of `sample` different texts, those of least hash."""
    spark = docs.sparkSession
    hashed = docs.filter("text is not null").withColumn("mark", F.xxhash64("text"))
    last = hashed.select("mark").distinct().orderBy("mark").limit(sample).agg(F.max("mark")).first()[0]  # marks alone are sorted, not texts
    some = written(hashed.filter(F.col("mark") <= F.lit(last).cast("long")).dropDuplicates(["mark"]))
    some = some.select(paragraphs(F.col("text")).alias("all"))
    some = some.select(F.explode(F.transform("all", lambda x, i: F.struct(x.alias("text"), around(F.col("all"), i).alias("near")))).alias("x"))
    lines = some.select("x.text", ngrams(F.col("x.near")).alias("near")).filter("length(text) > 0")
    lines = written(lines.select("text", holds(F.col("near"), 0.5, templates).alias("known"))).withColumn("grams", ngrams(F.col("text")))
    known = F.col("known")
    unknown = lines.filter(~known).select(F.lit(UNKNOWN).alias("label"), "grams", F.lit(1.0).alias("weight"), (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held"))
    stated = _statements(spark).select("label", ngrams(F.col("text")).alias("grams"), "weight", "held")
    rows = written(stated.union(unknown))
    vector = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=features, binary=True, minDF=2.0).fit(rows)
    seen = vector.transform(rows).withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=0.0002, maxIter=60, weightCol="weight").fit(seen.filter("not held"))
    from pyspark.ml.functions import vector_to_array

    t = temperature(model.transform(seen.filter("held")).select("label", vector_to_array("rawPrediction").alias("z")))
    coefficients, intercepts = model.coefficientMatrix.toArray() / t, list(model.interceptVector.toArray() / t)
    classes = len(intercepts)
    pad = lambda xs, low: [*map(float, xs), *[low] * (UNKNOWN + 1 - classes)]
    table = [(g, pad(coefficients[:, k], 0.0)) for k, g in enumerate(vector.vocabulary)]
    return table, pad(intercepts, -30.0)


def temperature(held: DataFrame) -> float:
    """What rows (label, z) held out of the fit, of all classes, say that scores are to be divided by: the temperature of least mean log loss, each class counting alike."""
    grid = [2.0 ** (k / 4) for k in range(-8, 17)]
    loss = lambda t: F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("z")) / t))) - (F.get("z", F.col("label").cast("int")) - F.array_max("z")) / t
    by = held.groupBy("label").agg(*[F.avg(loss(t)).alias(f"t{k}") for k, t in enumerate(grid)])
    losses = by.agg(*[F.avg(f"t{k}") for k in range(len(grid))]).first()
    return grid[min(range(len(grid)), key=lambda k: (losses[k] if losses[k] is not None else abs(grid[k] - 1), k))]


def bound(weights: dict[str, list[float]], intercepts: list[float], least: float) -> tuple[dict[str, float], float]:
    """Gains of n-grams, and what those of a paragraph must sum to for it to be a licence with a probability of `least`.

    The odds against the unknown class grow by a factor of at most exp(gain) with each
    n-gram, gain being its best lead over that class.
    """
    lead = log(least / (1 - least)) - log(sum(exp(b - intercepts[UNKNOWN]) for b in intercepts[:UNKNOWN]))
    return {g: gain for g, w in weights.items() if (gain := max(w[:UNKNOWN]) - w[UNKNOWN]) > 0}, lead


def reaches(grams: Column, gains: dict[str, float], lead: float) -> Column:
    """Do the gains of n-grams sum to `lead`? Those without a gain are left out first."""
    if lead <= 0:
        return F.lit(True)
    names = sorted(gains)
    of = F.array(*[F.lit(gains[g]) for g in names])
    some = F.array_intersect(grams, listed(names))
    return F.aggregate(some, F.lit(0.0), lambda have, g: have + F.get(of, (F.array_position(listed(names), g) - 1).cast("int"))) >= lead - 1e-6


def license_scan(docs: DataFrame, sample: int = 300, features: int = 4096, overlap: float = 0.6, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: `id_col`, licences (confirmed families, sorted), n_found (confirmed paragraphs), n_unconfirmed, best (highest probability of a confirmed one)."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    own = template_grams(spark)
    table, intercepts = fit(given.select("text"), sample, features, own)
    templates = [(f, t) for f in FAMILIES for t in TEMPLATES[f]]
    weights = {g: w for g, w in table if any(abs(x) > 1e-9 for x in w)}
    pairs = [[g for g in grams if " " in g] for grams in own]  # templates are compared in order: by their pairs of words
    sizes = [len(grams) for grams in pairs]
    held_in: dict[str, list[int]] = {}
    for k, grams in enumerate(pairs):
        for g in grams:
            held_in.setdefault(g, []).append(k)
    for c, f in enumerate(FAMILIES):
        for g in MARKS[f]:
            held_in.setdefault(g, []).append(len(templates) + c)
    zero = [0.0] * (UNKNOWN + 1)
    rows = [(g, weights.get(g, zero), held_in.get(g, [])) for g in sorted({*weights, *held_in})]  # at most `features` and the templates' own
    model = F.broadcast(spark.createDataFrame(rows, "gram string, w array<double>, holds array<int>"))
    gains, lead = bound(weights, intercepts, least)
    texts = given.filter("text is not null").select("id", "mark", paragraphs(F.col("text")).alias("all"))
    places = F.sequence(F.lit(0), F.size("all") - 1)
    # a run is confirmed by a family's own word alone: only runs about lines with a part of one are looked at
    both = lambda g: F.struct(reaches(g, gains, lead).alias("likely"), F.arrays_overlap(g, listed(RARE)).alias("about"))
    at = texts.withColumn("is", F.transform("all", lambda x: F.get(F.transform(F.array(ngrams(x)), both), 0)))
    alone = F.transform(F.filter(places, lambda i: F.get("is", i)["likely"]), lambda i: unit(F.col("all"), i, i))
    runs = F.flatten(F.transform(F.filter(places, lambda i: F.get("is", i)["about"]), lambda i: runs_at(F.col("all"), i, overlap, own)))
    # explode_outer: a filter on the array's size, own or inferred, would make every array twice
    found = at.select("id", "mark", F.explode_outer(F.concat(alone, runs)).alias("u")).filter("u is not null")
    lines = found.select("id", "mark", "u.a", "u.b", "u.line")
    grams = lines.dropDuplicates(["id", "mark", "a", "b"]).select("id", "mark", "a", "b", F.explode(ngrams(F.col("line"))).alias("gram"))
    hits = grams.join(model, "gram")
    sums = [F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(UNKNOWN + 1)]
    held = [F.count_if(F.array_contains("holds", k)).alias(f"t{k}") for k in range(len(templates) + UNKNOWN)]
    scored = hits.groupBy("id", "mark", "a", "b").agg(*sums, *held)
    shares = [F.when(F.col(f"t{len(templates) + c}") > 0, F.greatest(F.lit(0.0), *[F.col(f"t{k}") / sizes[k] for k, (g, _) in enumerate(templates) if g == f])).otherwise(0.0) for c, f in enumerate(FAMILIES)]
    place = ["id", "mark", "a", "b"]
    scored = scored.select(*place, F.array(*[F.col(f"z{c}") + intercepts[c] for c in range(UNKNOWN + 1)]).alias("z"), F.array(*shares).alias("shares"))
    scored = scored.select(*place, "shares", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    scored = scored.select(*place, "shares", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda have, y: have + y)).alias("p"))
    # the family that is likelier than all else, by how much of a template the paragraph holds
    best = F.array_max(F.transform(F.slice("p", 1, UNKNOWN), lambda p, c: F.struct(F.when(p >= least, F.get("shares", c)).otherwise(0.0).alias("share"), p.alias("p"), F.get(listed(FAMILIES), c).alias("family"))))
    named = scored.filter(1 - F.get("p", F.lit(UNKNOWN)) >= least).select(*place, best.alias("best"))
    sure = F.col("best.share") >= overlap
    whole = F.struct((F.col("b") - F.col("a")).alias("more"), "a", "b", F.col("best.family").alias("family"), F.col("best.p").alias("p"))
    told = named.filter(sure | (F.col("a") == F.col("b"))).groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.when(sure, whole))).alias("sure"), F.collect_list(F.when(~sure, F.col("a"))).alias("unsure"))
    meets = lambda u, v: (u["a"] <= v["b"]) & (v["a"] <= u["b"])
    apart = F.aggregate("sure", F.slice("sure", 1, 0), lambda have, u: F.when(F.exists(have, lambda v: meets(u, v)), have).otherwise(F.concat(have, F.array(u))))
    unsure = F.size(F.filter("unsure", lambda i: ~F.exists("sure", lambda v: (v["a"] <= i) & (i <= v["b"]))))
    told = told.select("id", "mark", apart.alias("apart"), unsure.alias("n_unconfirmed"))
    found = told.select("id", "mark", F.array_sort(F.array_distinct(F.transform("apart", lambda u: u["family"]))).alias("licences"), F.size("apart").cast("long").alias("n_found"), F.col("n_unconfirmed").cast("long").alias("n_unconfirmed"), F.array_max(F.transform("apart", lambda u: F.round(u["p"], 4))).alias("best"))
    same = [F.col("d.id").eqNullSafe(F.col("f.id")), F.col("d.mark").eqNullSafe(F.col("f.mark"))]
    out = given.select("id", "mark").alias("d").join(found.alias("f"), same, "left")
    return out.select(F.col("d.id").alias(id_col), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"), "best")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_license_scan": op10_license_scan}
SQL: dict[str, str] = {}
