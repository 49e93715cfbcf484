"""Licence scans in DataFrame functions alone.

Headers (lines that hold a licence word, and runs of short lines around them, since headers are wrapped) and whole files
that have such lines are compared with licence templates by the cosine of sparse TF-IDF vectors: terms are exploded and
joined to the templates' weights, a table of fixed size. A file whose whole text is a licence, or that is named as a
licence and holds a licence's title, covers its directory; every file takes the licence of its nearest ancestor
directory that has one, by joins on the path's prefixes, unless its own headers name another.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Least cosine of a header, and of a whole file, to a template. A statement that differs in a telling word (another
#: version, another restriction) stays below the first.
HEADER, FILE = 0.7, 0.6
#: Lines that a wrapped header has at most, and the characters of a line that may be part of one.
WRAP_LINES, WRAP_CHARS = 5, 120
#: Least cosine of consecutive lines of a licence-named file to a title, and the lines joined at most.
TITLE, TITLE_LINES = 0.8, 4
#: Paths of licence files by name.
NAMED = r"(?i)(^|/)(un)?(licen[cs]e|copying)([-_][a-z0-9.+-]+)?(\.(txt|md|rst|html|lesser))?$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# A line is a header if it has one of these.
CUE = r"(?i)licen[cs]e|copyright|copyleft|\bspdx\b|redistribut|warrant(y|ies)|public domain|permission is hereby|creative commons|all rights reserved"

# The customary statements of public licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-2-Clause": ("Released under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC-BY-NC-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright to this work, CC0 1.0 Universal.", "Licensed under CC0 1.0."),
}

# What tells whole licence texts apart, their titles or first sentences.
TITLES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004",),
    "MIT": (TEMPLATES["MIT"][2] + ' (the "Software"), to deal in the Software without restriction',),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "ISC": (TEMPLATES["ISC"][0],),
    "Unlicense": (TEMPLATES["Unlicense"][0],),
    "CC-BY-4.0": ("Attribution 4.0 International",),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0 International",),
    "CC-BY-NC-4.0": ("Attribution-NonCommercial 4.0 International",),
    "CC-BY-ND-4.0": ("Attribution-NoDerivatives 4.0 International",),
    "CC-BY-NC-SA-4.0": ("Attribution-NonCommercial-ShareAlike 4.0 International",),
    "CC-BY-NC-ND-4.0": ("Attribution-NonCommercial-NoDerivatives 4.0 International",),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal",),
}


def _terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def template_weights(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """Rows (licence, template, term, weight) of unit vectors; the terms' idf; the idf of a term in no template."""
    texts = [(name, k, _terms(t)) for name, ts in templates.items() for k, t in enumerate(ts)]
    df = Counter(term for _, _, terms in texts for term in set(terms))
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, k, terms in texts:
        tf = Counter(terms)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        rows += [(name, k, t, n * idf[t] / norm) for t, n in sorted(tf.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def _template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows, idf, _ = template_weights(templates)
    return spark.createDataFrame([(*r, idf[r[2]]) for r in rows], "license string, template int, term string, weight double, idf double")


def _best(units: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """units(unit, text...) -> (unit, license, score): the nearest template of each unit that shares a term with one.

    Units are partitioned by their key once; all that follows groups and joins by it, and so shuffles no terms.
    """
    units = units.dropDuplicates(["unit"])
    spark = units.sparkSession
    table = _template_table(spark, templates)
    other = template_weights(templates)[2]
    terms = units.select("unit", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    tf = terms.groupBy("unit", "term").agg(F.count("*").alias("tf"))
    idf = table.select("term", "idf").distinct()
    # both tables are fixed with the templates, a few hundred rows
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))).drop("idf", "tf")
    norm = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(table), "term").groupBy("unit", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("unit").agg(F.min(F.struct(-F.col("score"), F.col("license").alias("license"))).alias("b"))
    return best.select("unit", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"))


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, path, license, score, n_headers, inherited, inherited_from, effective) for every row of files.

    license is the file's own, by its best header or its whole text, '' if none reaches the threshold; a header is a line
    with a licence word, or up to WRAP_LINES lines of at most WRAP_CHARS characters with such a line among them, joined.
    n_headers counts the lines with a licence word that are in such a header. inherited is that of the nearest ancestor
    directory with a licence file, its own directory first ('' if none); of several there, the best score, then the
    smallest licence name. effective is license, or else inherited. A null text has no headers; a null path counts as
    ''. Rows that repeat both id and path are one file, scanned together.
    """
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    cued = rows.where(F.regexp_like("text", F.lit(CUE)))
    places = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.regexp_like(x, F.lit(CUE)), i)), lambda i: i.isNotNull())
    parted = cued.select("id", "path", F.split("text", "\n", -1).alias("all"), places.alias("cues"), "text")
    # each cue with the lines around it that a wrapped header may have
    around = F.transform("cues", lambda c: F.struct(
        c.alias("c"), F.least(c, F.lit(WRAP_LINES - 1)).alias("at"),
        F.slice("all", F.greatest(c - WRAP_LINES + 2, F.lit(1)), F.least(c, F.lit(WRAP_LINES - 1)) + WRAP_LINES).alias("near"),
    ))
    found = cut(parted.select("id", "path", around.alias("cues"), "text"))
    key = F.struct("id", "path")
    cues = found.select(key.alias("file"), F.explode("cues").alias("z")).select("file", "z.*")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("at")), lambda a: F.transform(
        F.sequence(F.col("at"), F.least(a + WRAP_LINES, F.size("near")) - 1), lambda b: F.slice("near", a + 1, b - a + 1)
    )))
    spans = F.filter(spans, lambda x: (F.size(x) == 1) | F.forall(x, lambda ln: F.length(ln) <= WRAP_CHARS))
    headers = cues.select("file", "c", F.explode(F.transform(spans, lambda x: F.array_join(x, " "))).alias("text"))
    headers = headers.select("file", "c", F.sha2("text", 256).alias("unit"), "text")
    # equal units have equal scores, so each distinct one is compared once
    by_line = _best(headers.select("unit", "text")).where(F.col("score") >= HEADER)
    whole = found.select(F.sha2("text", 256).alias("unit"), "text")
    by_file = _best(whole).where(F.col("score") >= FILE)
    least = F.min(F.struct(-F.col("score"), F.col("license").alias("license"))).alias("b")
    named = headers.select("file", "c", "unit").join(by_line, "unit").groupBy("file", "c").agg(least)
    named = named.select("file", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"), F.lit(1).alias("header"))
    files_named = found.select(key.alias("file"), F.sha2("text", 256).alias("unit")).join(by_file, "unit").select("file", "license", "score", F.lit(0).alias("header"))
    # the title stands anywhere in a licence-named file, wrapped over lines
    full = found.where(F.regexp_like("path", F.lit(NAMED))).select(key.alias("file"), F.split("text", "\n", -1).alias("lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda k: F.transform(F.sequence(F.lit(1), F.lit(TITLE_LINES)), lambda n: F.array_join(F.slice("lines", k, n), " ")))
    windows = full.select("file", F.explode(F.array_distinct(F.flatten(windows))).alias("text"))
    by_title = _best(windows.select(F.col("text").alias("unit"), "text"), TITLES).where(F.col("score") >= TITLE)
    titled = windows.join(by_title, F.col("text") == F.col("unit")).select("file", "license", "score", F.lit(0).alias("header"))
    files_named = files_named.unionByName(titled)
    own = named.unionByName(files_named).groupBy("file").agg(least, F.sum("header").cast("long").alias("n_headers"))
    own = own.select(F.col("file.id").alias("i"), F.col("file.path").alias("p"), F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score"), "n_headers")

    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    covering = files_named.select(F.col("file.path").alias("path"), "license", "score").withColumn("at", parent)
    covering = covering.groupBy("at").agg(least).select("at", F.col("b.license").alias("inherited"))
    dirs = rows.select(parent.alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    nearest = dirs.select("dir", F.explode(F.array_distinct(up)).alias("at")).join(covering, "at")
    nearest = nearest.groupBy("dir").agg(F.max_by(F.struct("inherited", "at"), F.length("at")).alias("n")).select("dir", "n.*")

    base = rows.select("id", "path", parent.alias("dir")).join(nearest, "dir", "left")
    out = base.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("path") == F.col("p")), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        F.col("id").alias(id_col), "path", text("license").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"), text("inherited").alias("inherited"), text("at").alias("inherited_from"),
        F.coalesce("license", "inherited", F.lit("")).alias("effective"),
    )


def document_path() -> Column:
    """documents have no paths: source and language make the directories."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def _values() -> str:
    rows, idf, _ = template_weights()
    return ", ".join(f"('{a}', {k}, '{t}', {w!r}, {idf[t]!r})" for a, k, t, w in rows)


ORACLE_SQL = f"""
with tpl(license, template, term, weight, idf) as (values {_values()}),
idfs as (select distinct term, idf from tpl),
rows_ as (select doc_id as id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' as path, coalesce(source, '') || '/' || coalesce(lang, '') as dir, coalesce(text, '') as text from documents),
found as (select * from rows_ where regexp_matches(text, '{CUE}')),
parted as (select id, path, dir, string_split(text, chr(10)) as ls from found),
cues as (select *, unnest(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{CUE}'))) as c from parted),
firsts as (select *, unnest(generate_series(greatest(c - {WRAP_LINES - 1}, 1), c)) as a from cues),
spans as (select *, unnest(generate_series(c, least(a + {WRAP_LINES - 1}, len(ls)))) as b from firsts),
headers as (select id, path, dir, c, array_to_string(ls[a:b], ' ') as text from spans
  where a = b or len(list_filter(ls[a:b], lambda x: length(x) > {WRAP_CHARS})) = 0),
units as (select distinct text from (select text from headers union all select text from found)),
terms as (select text as unit, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from units),
tf as (select unit, term, count(*) as tf from terms group by all),
weighted as (select unit, tf.term, tf * coalesce(idf, {template_weights()[2]!r}) as w from tf left join idfs on tf.term = idfs.term),
norms as (select unit, sqrt(sum(w * w)) as norm from weighted group by unit),
dots as (select unit, license, template, sum(w * weight) as dot from weighted join tpl on weighted.term = tpl.term group by all),
scored as (select d.unit, license, round(dot / norm, 6) as score from dots d join norms n on d.unit = n.unit),
best as (select unit, license, score from (select *, row_number() over (partition by unit order by score desc, license) as r from scored) where r = 1),
named as (select id, path, dir, license, score, 1 as header from (select h.*, license, score,
    row_number() over (partition by id, path, c order by score desc, license) as r from headers h join best b on h.text = b.unit where score >= {HEADER}) where r = 1
  union all select id, path, dir, license, score, 0 from found f join best b on f.text = b.unit where score >= {FILE}),
own as (select id, path, n_headers, license, score from (select *, sum(header) over (partition by id, path) as n_headers,
  row_number() over (partition by id, path order by score desc, license) as r from named) where r = 1),
covering as (select dir as at_, license as inherited from (select *, row_number() over (partition by dir order by score desc, license) as r from named where header = 0) where r = 1)
select r.id as doc_id, r.path, coalesce(o.license, '') as license, coalesce(o.score, 0.0) as score, cast(coalesce(n_headers, 0) as bigint) as n_headers,
  coalesce(inherited, '') as inherited, coalesce(at_, '') as inherited_from, coalesce(o.license, inherited, '') as effective
from rows_ r left join own o on r.id = o.id and r.path = o.path left join covering c on r.dir = c.at_"""
