"""Licence scanning with a positional index of rare words, in DataFrame operations only.

Templates are licence notices with key phrases that must stand in a match.  A word's IDF
is over the templates, so a file's labels don't depend on other files.  The index holds,
for each template, the offsets of its ``rare`` words of highest IDF.  A file's licence words
are looked up from the highest IDF on (``look`` distinct ones); each place of such a word
votes, by every posting of it, for a template that starts at the place less the offset.  A
template that gets half of its postings or more at one start is a match if one of its key
phrases stands there too, word for word, where the template has it.

Texts are read once: those in which some phrase stands, key or base, without which nothing
matches, go to a table in the shared folder, and the index is looked up from there.  The index is as large as the templates, so it is broadcast.

Defined results: a null text is empty; a text without licence words has no places, null
first_word and last_word, empty labels and score 0; the score is the greatest share of a
matching template's postings; null and repeated doc_ids pass through; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: One of them must stand in the match; each is part of ``words``.
    keys: tuple[str, ...]


# Notices of public licences, lower case, words only.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("hereby granted free of charge to any person",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ("terms of the gnu general public license",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("purpose with or without fee is hereby granted",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    Template("bsl", "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
)


def word_array(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


@dataclass(frozen=True)
class Index:
    """Postings (word, template, offset) of each template's rare words, and words by falling IDF."""

    postings: tuple[tuple[str, int, int], ...]
    words: tuple[str, ...]
    sizes: tuple[int, ...]
    #: Of each phrase, key or base, the word of the highest IDF: no match without one of them.
    anchors: tuple[str, ...]


def build_index(templates: tuple[Template, ...], rare: int, phrases: tuple[str, ...] = ()) -> Index:
    seen = Counter(w for t in templates for w in set(t.words.split()))
    idf = {w: math.log(len(templates) / n) for w, n in seen.items()}
    rank = lambda w: (-idf.get(w, math.inf), w)
    postings = []
    for k, t in enumerate(templates):
        own = t.words.split()
        chosen = set(sorted(set(own), key=rank)[:rare])
        postings += [(w, k, i) for i, w in enumerate(own) if w in chosen]
    sizes = Counter(k for _, k, _ in postings)
    return Index(tuple(postings), tuple(sorted({w for w, _, _ in postings}, key=rank)), tuple(sizes[k] for k in range(len(templates))), tuple(sorted({min(p.split(), key=rank) for p in (*phrases, *(k for t in templates for k in t.keys))})))


def phrase_places(words: str, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively in an array column, overlaps included."""
    own = phrase.split()
    stands = lambda x, i: (x == own[0]) & (F.slice(words, i + 1, F.lit(len(own))) == strings(own))
    return F.array_compact(F.transform(words, lambda x, i: F.when(stands(x, i), i)))


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def matches(files: DataFrame, templates: tuple[Template, ...], rare: int, look: int) -> DataFrame:
    """(rid, labels, score) of files (rid, w) that match a template."""
    spark = files.sparkSession
    index = build_index(templates, rare)
    postings = F.broadcast(spark.createDataFrame(list(index.postings), "word string, template int, offset int"))
    about = [(k, t.label, index.sizes[k], [(_find(t.words.split(), p.split()), p.split()) for p in t.keys]) for k, t in enumerate(templates)]
    about_rows = F.broadcast(spark.createDataFrame(about, "template int, label string, size int, keys array<struct<at: int, words: array<string>>>"))
    # The first list decides the order of an intersection: words by falling IDF.
    chosen = files.select("rid", "w", F.slice(F.array_intersect(strings(index.words), F.col("w")), 1, look).alias("own"))
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("pos"))), lambda o: F.array_contains("own", o["word"]))
    looked = chosen.where(F.size("own") > 0).select("rid", F.explode(places).alias("o")).select("rid", "o.word", "o.pos")
    votes = looked.join(postings, "word").groupBy("rid", "template", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    strong = votes.join(about_rows, "template").where("2 * n >= size")
    there = F.exists("keys", lambda k: (F.col("start") + k["at"] >= 0) & (F.slice("w", F.greatest(F.col("start") + k["at"] + 1, F.lit(1)), F.size(k["words"])) == k["words"]))
    met = strong.join(files.select("rid", "w"), "rid").where(there)
    return met.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max(F.col("n") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] | None = None, rare: int = 8, look: int = 256) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = BASE if base is None else base
    anchors = strings(build_index(templates, rare, tuple(base)).anchors)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), word_array(F.col("text")).alias("w"))
    # Words hold no blanks, so a phrase stands in the array if it stands in the joined words.
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    phrases = sorted({*base, *(k for t in templates for k in t.keys)})
    stands = reduce(lambda a, b: a | b, [joined.contains(f" {p} ") for p in phrases])
    files = written(read.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", anchors) & stands, F.col("w")).alias("w")), "licence")
    places = [phrase_places("w", p) for p in base]
    own = files.select("rid", "doc_id", "n_words", *[F.coalesce(p, F.array().cast("array<int>")).alias(f"p{i}") for i, p in enumerate(places)])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(base.values())]))
    own = own.select("rid", "doc_id", "n_words", F.concat(*[F.col(f"p{i}") for i, _ in enumerate(base)]).alias("places"), labels.alias("base"))
    found = matches(files.where("w is not null").select("rid", "w"), templates, rare, look)
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return own.join(found, "rid", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
