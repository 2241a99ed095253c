"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block of a text for a template is a run of consecutive words, whatever the line breaks between them, as long as the
template and as many words more as THRESHOLD leaves room for; every run of a text is a block. A template is a set of
words; a block holds it if it has at least THRESHOLD of the template's words, so words scattered over more than a block
do not count. Words are ordered by how many texts have them, rarest first. A block that holds a template shares at
least ``need = ceil(THRESHOLD * size)`` words with it, hence one of the ``size - need + 1`` rarest (prefix filter); its
text has at least ``need`` of them (length filter); and if the first word that the text has is the k-th of the template,
``size - k`` are left, which must reach ``need`` (positional filter). Texts that pass meet the template once, and their
blocks are verified by counting shared words; blocks that start at a template word suffice, as any other has no more of
them than one of these.

Besides, phrases are found wherever their words stand one after another (base labels).

Templates are a fixed, small table, so the join's build side has a proven bound. Only texts with a word of a prefix
leave the scan; nothing is grouped by a word of the corpus, so frequent words do not gather in a task.

Defined cases: a null text is empty: no words, no labels, null first and last word, score 0. Ties between templates
give all their labels. Repeated rows give a row each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, table

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The wording of public licenses' notices. Words as in the documents.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-release": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}
#: A block holds a template from this share of the template's words on, in percent.
THRESHOLD = 80

#: What is not a word: ASCII without digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The one character beyond ASCII whose lower case is an ASCII letter of its own.
KELVIN = "K"


def _tokens(text: str) -> list[str]:
    import re

    return [w for w in re.split(GAP, text.lower()) if w]


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(_tokens(v))) for k, v in sorted(templates.items())}


def block_words(templates: dict[str, str], threshold: int = THRESHOLD) -> dict[str, int]:
    """Words of a block for each template."""
    return {k: -(-len(_tokens(v)) * 100 // threshold) for k, v in templates.items()}


def _lower(text: Column) -> Column:
    """A-Z in lower case. lower() does the same to every ASCII word and is faster, but for one character."""
    return F.when(text.contains(KELVIN), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _spaced(text: Column) -> Column:
    """The words of a text, each with one blank before and the last with one after."""
    return F.regexp_replace(F.concat(F.lit(" "), _lower(text), F.lit(" ")), GAP, " ")


def _has(spaced: str, word: str) -> Column:
    return F.col(spaced).contains(f" {word} ")


def _split(text: Column) -> Column:
    """The words of a text in order; the first and last may be empty."""
    return F.split(_lower(text), GAP)


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_order(texts: DataFrame, words: list[str], text: str) -> DataFrame:
    """(word, place): template words by how many texts have them, rarest first; ties by the word. As many rows as template words."""
    held = texts.select(F.explode(F.array_intersect(_split(F.col(text)), _array(words))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = texts.sparkSession.createDataFrame([(w,) for w in words], "word string")
    row = own.join(held, "word", "left").select(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word").alias("s"))
    return row.agg(F.sort_array(F.collect_list("s")).alias("s")).select(F.posexplode("s").alias("place", "s")).select(F.col("s.word").alias("word"), "place")


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, label, shared, size): every text with a block that holds a template, h a hash of the text, with the
    template's words that the best block has."""
    need(docs, key, text)
    sets, spans = template_words(templates), block_words(templates, threshold)
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    least = {k: -(-len(ws) * threshold // 100) for k, ws in sets.items()}
    given = docs.where(F.col(text).isNotNull())
    # The order, as many words as the templates have; it goes into the plan of the scan.
    place = {r["word"]: r["place"] for r in word_order(given, vocabulary, text).collect()}
    spark = docs.sparkSession
    rows = []
    for k, ws in sets.items():
        ws = sorted(ws, key=place.__getitem__)
        rows += [(k, len(ws), least[k], spans[k], ws, i, w) for i, w in enumerate(ws[: len(ws) - least[k] + 1])]
    prefix = spark.createDataFrame(rows, "label string, size int, need int, span int, t_words array<string>, k int, word string")
    rare = sorted({r[-1] for r in rows})
    # Prefix filter: most texts have no such word.
    near = given.where(F.arrays_overlap(_split(F.col(text)), _array(rare))).select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), _split(F.col(text)).alias("a"))
    known = _array(vocabulary)
    at = F.filter(F.transform("a", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(known, x["word"]))
    near = near.select("doc", "h", at.alias("all"))
    near = near.withColumn("words", F.array_distinct(F.transform("all", lambda x: x["word"])))
    rows = near.select("doc", "h", "all", "words", F.explode(F.array_intersect("words", _array(rare))).alias("word"))
    pairs = rows.join(F.broadcast(prefix), "word").where((F.size("words") >= F.col("need")) & (F.col("size") - F.col("k") >= F.col("need")))
    # A pair counts once: by the first word of the template that the text has.
    first = F.element_at(F.filter("t_words", lambda w: F.array_contains(F.col("words"), w)), 1) == F.col("word")
    pairs = pairs.where(first & (F.size(F.array_intersect("words", "t_words")) >= F.col("need")))
    hits = F.filter("all", lambda x: F.array_contains(F.col("t_words"), x["word"]))

    def most(h: Column) -> Column:
        def held(x: Column, i: Column) -> Column:
            inside = F.filter(F.slice(h, i + 1, F.col("span")), lambda y: y["at"] < x["at"] + F.col("span"))
            return F.size(F.array_distinct(F.transform(inside, lambda y: y["word"])))

        return F.array_max(F.transform(h, held))

    # As a column, Spark would put the expression of the hits in each place, and take squares of time.
    best = pairs.withColumn("shared", F.get(F.transform(F.array(hits), most), F.lit(0))).where(F.col("shared") >= F.col("need"))
    return best.select(F.col("doc").alias(key), "h", "label", "shared", "size")


def _places(phrase: str, label: str) -> Column:
    """Starts of a phrase in the word array a."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size("a") - len(parts))
    at = F.filter(starts, lambda i: reduce(and_, [F.get("a", i + j) == w for j, w in enumerate(parts)]))
    return F.when(F.size("a") >= len(parts), F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: words, places of phrases, and labels of phrases and templates."""
    need(docs, key, text)
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), _spaced(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    n_words = F.greatest(F.length("w") - F.length(F.replace(F.col("w"), F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")
    # Work on word arrays only where a phrase is there at all.
    hit = F.when(reduce(or_, [_has("w", p) for p in phrases]), F.split(F.trim("w"), " "))
    base = base.select("doc", "h", n_words.alias("n_words"), hit.alias("a"))
    places = [_places(phrase, label) for phrase, label in phrases.items()]
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    base = base.select("doc", "h", "n_words", F.concat(*[F.coalesce(x, none) for x in places]).alias("p"))
    found = template_matches(docs, templates, threshold, key, text).groupBy(F.col(key).alias("t_doc"), F.col("h").alias("t_h")).agg(
        F.collect_set("label").alias("t_labels"), F.max(F.col("shared") / F.col("size")).alias("t_score")
    )  # collect_set: one value for each template at most
    out = base.join(found, F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("h") == F.col("t_h")), "left")
    own = F.array_distinct(F.transform("p", lambda x: x["label"]))
    extra = F.coalesce("t_labels", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(key),
        "n_words",
        F.size("p").cast("long").alias("n_base"),
        F.array_min(F.transform("p", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("p", lambda x: x["at"])).alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(own, extra)), ",").alias("labels"),
        F.greatest(F.coalesce("t_score", F.lit(0.0)), F.when(F.size("p") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    sets, spans = template_words(TEMPLATES), block_words(TEMPLATES)
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    lists = {p: "[" + ", ".join(f"'{w}'" for w in p.split(" ")) + "]" for p in PHRASES}
    base = "list_sort(list_concat(" + ", ".join(f"list_transform(list_filter(range(len(a)), lambda i: a[i + 1 : i + {len(p.split(' '))}] = {lists[p]}), lambda i: {{'at': i, 'label': '{v}'}})" for p, v in PHRASES.items()) + "))"
    rows = ", ".join(f"('{k}', [{', '.join(repr(w) for w in ws)}], {spans[k]})" for k, ws in sets.items())
    return f"""
WITH w AS (SELECT doc_id, {words} AS a FROM documents),
b AS (SELECT doc_id, len(a) AS n_words, {base} AS p FROM w),
t(label, ws, span) AS (VALUES {rows}),
c AS (SELECT doc_id, a, label, ws, span FROM w, t WHERE 100 * len(list_intersect(a, ws)) >= {THRESHOLD} * len(ws)),
s AS (SELECT doc_id, label, ws, len(list_intersect(a[i : i + span - 1], ws)) AS shared FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM c) WHERE list_contains(ws, a[i])),
m AS (SELECT doc_id, label, max(shared / len(ws)) AS score FROM s WHERE 100 * shared >= {THRESHOLD} * len(ws) GROUP BY ALL),
g AS (SELECT doc_id, list(label) AS ls, max(score) AS score FROM m GROUP BY doc_id),
o AS (SELECT b.doc_id, n_words, p, list_distinct(list_transform(p, lambda x: x.label)) AS own, coalesce(ls, []) AS ls, score FROM b LEFT JOIN g ON b.doc_id = g.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word,
  CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, ls))), ',') AS labels, greatest(coalesce(score, 0.0), CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM o"""


OP7_SQL = _sql()
