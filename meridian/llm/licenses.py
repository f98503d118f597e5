"""License scans by an exact set-similarity join, with DataFrame functions only.

A template is a notice or a license text. A text block is 2 * n consecutive words of a text, n being the template's
words, and a block begins every n words; so wherever a notice stands and however its lines are broken, one block holds
it. A block matches if it holds CONTAINMENT or more of the template's distinct tokens. Tokens are ordered by how often
all documents use them, the rarest first; the join meets blocks in a template's prefix in that order, applies the length
and the positional filter, and verifies each pair found, so it finds all matches.
Null text counts as empty. Repeated rows each give a row; rows of one doc_id are told apart by their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import pick, small, stored

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The words of license texts, of the notices that they ask for, and of the usual one-line statements.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "lgpl-header": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
CONTAINMENT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_tokens() -> dict[str, list[str]]:
    return {k: sorted(set(v.split())) for k, v in TEMPLATES.items()}


def needed(tokens: int) -> int:
    return math.ceil(CONTAINMENT * tokens - 1e-9)


def _folded(text: Column) -> Column:
    """A-Z lower-cased. lower() folds other letters too, which moves no word and makes no base or template word,
    but for the two letters whose lower case holds an ASCII one: texts with these take the slow exact way."""
    t = F.coalesce(text, F.lit(""))
    odd = t.contains("\u212a") | t.contains("\u0130")
    return F.when(odd, F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells texts of one doc_id apart) and the words of each row."""
    text = _folded(F.col("text"))
    return pick(docs, "doc_id", "text").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"), F.filter(F.split(text, GAP), lambda w: w != "").alias("w"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])))


def order(words: DataFrame) -> dict[str, int]:
    """The rank of each template token, those that all texts use least first. One row per token: bounded by the templates."""
    every = sorted({t for ts in template_tokens().values() for t in ts})
    known = F.broadcast(_rows(words.sparkSession, [(t,) for t in every], "token string"))
    n = {r[0]: r[1] for r in words.select(F.explode("w").alias("token")).join(known, "token").groupBy("token").count().collect()}
    return {t: i for i, t in enumerate(sorted(every, key=lambda t: (n.get(t, 0), t)))}


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, key, block, template, containment) of every block that meets a template's threshold."""
    spark, words = docs.sparkSession, _words(docs)
    rank = order(words)
    index, every = [], []
    for name, tokens in template_tokens().items():
        by_rank = sorted(tokens, key=rank.__getitem__)
        m, need, n = len(tokens), needed(len(tokens)), len(TEMPLATES[name].split())
        every += [(name, by_rank, m, need, n)]
        # The prefix: whoever holds need of the tokens holds one of these. After place `at`, m - at tokens are left.
        index += [(t, name, at, m, need, n) for at, t in enumerate(by_rank[: m - need + 1])]
    index = F.broadcast(_rows(spark, index, "token string, template string, at int, m int, need int, n int"))
    met = words.select("doc_id", "key", F.size("w").alias("size"), F.posexplode("w").alias("pos", "token")).join(index, "token")
    met = met.select("doc_id", "key", "template", "size", "at", "m", "need", "n", F.explode(F.expr("if(pos < n, array(0), array(pos div n - 1, pos div n))")).alias("block"))
    # Length: a block of fewer words can't hold enough tokens. Position: the tokens from the rarest one met on must do.
    length = F.least(2 * F.col("n"), F.col("size") - F.col("block") * F.col("n")) >= F.col("need")
    pairs = met.where(length).groupBy("doc_id", "key", "template", "block").agg(F.min(F.col("at")).alias("at"), F.first("m").alias("m"), F.first("need").alias("need")).where("m - at >= need")
    pairs = stored(pairs.select("doc_id", "key", "template", "block"))
    marked = pairs.select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    held = words.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").distinct()
    at = pairs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "template", "block").join(F.broadcast(_rows(spark, every, "template string, tokens array, m int, need int, n int")), "template")
    shared = F.size(F.array_intersect(F.expr("slice(w, cast(block * n + 1 as int), 2 * n)"), F.col("tokens")))
    rows = at.join(held, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).withColumn("shared", shared).where("shared >= need")
    return rows.select("doc_id", "key", "block", "template", (F.col("shared") / F.col("m")).alias("containment"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns, one row per row of docs."""
    places = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " and ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(words))
        places.append(f"transform(filter(sequence(0, size(w) - 1), i -> coalesce({same}, false)), i -> struct(i as at, '{label}' as label))")
    # Places are looked for where a text holds all words of a phrase.
    may = " or ".join("(" + " and ".join(f"array_contains(w, '{x}')" for x in p.split()) + ")" for p in PHRASES)
    base = _words(docs).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.expr(f"if({may}, concat({', '.join(places)}), null)").alias("p"))
    found = hits(docs).groupBy("doc_id", "key").agg(F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    found = small(stored(found.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "more", "best")), 100 + 20 * len(TEMPLATES))
    out = base.join(found, base.doc_id.eqNullSafe(found.d) & (base.key == found.k), "left")
    own = F.coalesce(F.array_distinct(F.col("p.label")), F.array().cast("array<string>"))
    every = F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))
    line = lambda a: F.array_join(F.array_sort(a), ",")
    return out.select("doc_id", "n_words", F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_base"), F.array_min("p.at").cast("long").alias("first_word"), F.array_max("p.at").cast("long").alias("last_word"), line(own).alias("base_labels"), line(every).alias("labels"), F.when(F.size("p") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    """The report in DuckDB SQL: all pairs of blocks and templates, without the join's filters."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    places = [f"list_transform(list_filter(range(len(w)), lambda i: {' and '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items()]
    templates = ", ".join(f"('{k}', {t}, {needed(len(t))}, {len(TEMPLATES[k].split())})" for k, t in template_tokens().items())
    return f"""
with d as (select doc_id, text, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select *, regexp_extract_all(t, '{word}') as w from d),
p as (select *, {' || '.join(places)} as p from w),
b as (select doc_id, text, w, k, tokens, need, n, unnest(range(0, (len(w) + n - 1) // n)) as b from (select distinct doc_id, text, w from w) x, (values {templates}) v(k, tokens, need, n)),
m as (select doc_id, text, k, need, len(tokens) as m, len(list_intersect(list_distinct(w[b * n + 1 : b * n + 2 * n]), tokens)) as c from b),
h as (select doc_id, text, list(distinct k) as more, max(c / m) as best from m where c >= need group by all)
select p.doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base,
 cast(list_min(list_transform(p, lambda x: x.at)) as bigint) as first_word, cast(list_max(list_transform(p, lambda x: x.at)) as bigint) as last_word,
 coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || coalesce(more, []))), ','), '') as labels,
 case when len(p) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from p left join h on p.doc_id is not distinct from h.doc_id and p.text is not distinct from h.text"""


SQL = _sql()
