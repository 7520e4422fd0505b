"""License scans by a positional rare-token index. DataFrame operations only.

Base: places where a known phrase's words stand consecutively. The method adds labels of its own:

1. The licence words of the templates get an inverse document frequency over all documents, plus ``FLOOR``:
   words that many documents hold weigh little, but none is left out.
2. Of each template's own words, the ``TOP`` with the highest IDF are looked up with all their places, in
   the files that hold one of its mandatory key phrases.
3. Its postings are intersected by relative position: words that stand as far apart as in the template
   agree on one shift. Its support is the IDF of the words that agree on its best shift.
4. A template with support of ``SUPPORT`` of its rarest words' IDF counts.

All of it happens inside a row: no shuffle but for the document frequencies, whose groups are the few
words of the templates.

Defined cases: null text counts as empty; no words: n_words 0, null places, empty labels, score 0;
repeated rows are scanned each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label: its phrase.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: label: (a passage that is typical of it, key phrases of which one is mandatory).
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    "mit-name": ("released under the mit license", ("the mit license", "mit license")),
    "apache-2": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    "gpl-3": ("licensed under the gnu general public license version 3", ("gnu general public license version 3", "gnu gpl version 3", "gplv3")),
    "gpl-2": ("licensed under the gnu general public license version 2", ("gnu general public license version 2", "gplv2")),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl-3": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike", "cc by sa")),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0", "creative commons attribution 3 0")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}
#: A label of the table above whose name is another's.
ALIAS = {"mit-name": "mit"}
TOP, SUPPORT = 6, 0.6
#: The weight of a licence word that all documents hold.
FLOOR = 0.1


def words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def spaced(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def rarities(worded: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """The IDF, plus FLOOR, of each licence word that is there; at most as many rows as the templates have words."""
    held = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    rows = worded.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    total = df.pop("", 0)
    return {w: math.log(total / df[w]) + FLOOR for w in vocabulary if df.get(w, 0)}


def support(passage: str, idf: dict[str, float]) -> Column:
    """The share of the IDF of the passage's rarest words that agree on its best shift in ``words``."""
    split = passage.split()
    rarest = sorted({w for w in split if w in idf}, key=lambda w: (-idf[w], w))[:TOP]
    agreeing = []
    for w in rarest:
        places = F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
        by = F.array_distinct(F.flatten(F.array(*[shifted(places, i) for i, x in enumerate(split) if x == w])))
        agreeing.append(weighed(by, idf[w]))
    # in order, a shift's words stand together
    start = F.struct(F.lit(None).cast("int").alias("by"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def add(t: Column, x: Column) -> Column:
        total = F.when(t["by"] == x["by"], t["sum"] + x["idf"]).otherwise(x["idf"])
        return F.struct(x["by"].alias("by"), total.alias("sum"), F.greatest(t["best"], total).alias("best"))

    whole = 0.0
    for w in reversed(rarest):  # as the sums go, from the lowest on
        whole += idf[w]
    return F.aggregate(F.array_sort(F.concat(*agreeing)), start, add, lambda t: F.least(F.lit(1.0), t["best"] / whole))


def shifted(places: Column, i: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(i))


def weighed(by: Column, idf: float) -> Column:
    return F.transform(by, lambda x: F.struct(x.alias("by"), F.lit(idf).alias("idf")))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: dict = PHRASES, templates: dict = TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    worded = docs.select(F.col(key).alias("k"), words(F.col(text)).alias("words"))
    vocabulary = sorted({w for t, _ in templates.values() for w in t.split()})
    idf = rarities(worded, vocabulary)

    joined = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    base = worded.withColumns({"joined": joined, "n_words": F.size("words").cast("long")})
    any_ = F.lit(False)
    for p in phrases.values():
        any_ |= F.col("joined").contains(spaced(p))
    here = "(?= (?:" + "|".join(p.replace(" ", "  ") for p in phrases.values()) + ") )"
    count = F.lit(0).cast("long")
    for p in phrases.values():
        count += F.regexp_count("joined", F.lit("(?=" + spaced(p) + ")")).cast("long")
    before = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    found = base.withColumn("has", any_).withColumns({
        "n_base": F.when(F.col("has"), count).otherwise(0),
        "first_word": F.when(F.col("has"), before(F.expr(f"left(joined, regexp_instr(joined, '{here}') - 1)"))),
        "last_word": F.when(F.col("has"), before(F.regexp_extract("joined", "(?s)^(.*)" + here, 1))),
        "base": F.array_compact(F.array(*[F.when(F.col("has") & F.col("joined").contains(spaced(p)), F.lit(n)) for n, p in phrases.items()])),
    })

    hits = []
    for name, (passage, keys) in templates.items():
        if not any(w in idf for w in passage.split()):
            continue
        key_there = F.lit(False)
        for k in keys:
            key_there |= F.col("joined").contains(spaced(k))
        hits.append(F.when(key_there, F.struct(F.lit(ALIAS.get(name, name)).alias("label"), support(passage, idf).alias("support"))))
    if not hits:
        own = found.withColumn("hits", F.lit(None).cast("array<struct<label:string,support:double>>"))
    else:
        own = found.withColumn("hits", F.filter(F.array(*hits), lambda h: h.isNotNull() & (h["support"] >= SUPPORT)))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("hits", lambda h: h["label"]), F.array().cast("array<string>")))))
    score = F.when(F.col("has"), 1.0).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["support"])), F.lit(0.0)))
    return own.select(
        F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
