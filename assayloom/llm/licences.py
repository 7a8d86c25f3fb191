"""Licence labels of texts: a positional index of the rarest licence words, postings met by relative position, key phrases verified.

DataFrame functions only; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of a notice that are looked up, its rarest; a template that is one mandatory phrase needs one.
ANCHORS = 6
#: Index rows that are broadcast; a larger index meets the words by shuffle.
MOST_INDEX_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LicenceTemplate:
    """A notice in lower-case words, the phrases that must stand in it, and by how many words a copy may shift; base templates are counted as places."""

    label: str
    words: str
    phrases: tuple[str, ...]
    slack: int = 3
    base: bool = False


def exact_phrase(words: str, label: str) -> LicenceTemplate:
    return LicenceTemplate(label, words, (words,), slack=0, base=True)


# --- fixed values: wording of well-known notices -------------------------------------------------
NOTICES = (
    LicenceTemplate("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    LicenceTemplate("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    LicenceTemplate("mit", "released under the mit license", ("mit license",)),
    LicenceTemplate("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    LicenceTemplate("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    LicenceTemplate("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    LicenceTemplate("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    LicenceTemplate("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    LicenceTemplate("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    LicenceTemplate("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    LicenceTemplate("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    LicenceTemplate("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    LicenceTemplate("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    LicenceTemplate("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    LicenceTemplate("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; none for a null text."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_facts(texts: DataFrame, templates: list[LicenceTemplate]) -> DataFrame:
    """(template, label, base, slack, length, phrases, anchors, total): each template with its rarest words, their places and weights.

    A word weighs 1 + floor(1000 ln((N + 1) / (df + 1))) over all N texts, df of which hold it. A
    template's anchors are its heaviest words, each at its first place, ties to the earlier place.
    """
    spark = texts.sparkSession
    rows = [(t, x.label, x.base, x.slack, x.words.split(" "), list(x.phrases)) for t, x in enumerate(templates)]
    library = spark.createDataFrame(rows, "template int, label string, base boolean, slack int, twords array<string>, phrases array<string>")
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for x in templates for w in x.words.split(" ")})])
    held = texts.select(F.explode_outer(F.array_intersect(words_of(F.col("text")), vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n"))
    places = library.select("template", "slack", F.posexplode("twords").alias("tpos", "word")).groupBy("template", "slack", "word").agg(F.min("tpos").alias("tpos"))
    weighed = places.join(held, "word", "left").join(F.broadcast(total), F.lit(True))  # total is one row
    weighed = weighed.withColumn("weight", F.floor(1000 * F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))).cast("long") + 1)
    # a template's words in one array: as many as the notice has
    entry = F.struct((-F.col("weight")).alias("less"), "tpos", "word", "weight")
    ranked = weighed.groupBy("template", "slack").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    anchors = ranked.select("template", F.slice("all", F.lit(1), F.when(F.col("slack") == 0, 1).otherwise(ANCHORS)).alias("anchors"))
    facts = library.join(anchors, "template").withColumn("total", F.aggregate("anchors", F.lit(0).cast("long"), lambda s, a: s + a["weight"]))
    return facts.select("template", "label", "base", "slack", F.size("twords").alias("length"), "phrases", "anchors", "total")


def licence_places(texts: DataFrame, templates: list[LicenceTemplate]) -> DataFrame:
    """(id, text_hash, template, label, base, start, share): every place where a template of the library stands.

    texts has (id, text_hash, text). Each occurrence of an index word proposes a start: its place
    less its place in the template. The template's other anchors are then looked for at their
    places relative to that start, off by `slack` at most; those found must weigh half of all, and
    every key phrase must stand within the template's span, widened by slack. With slack 0 and the
    whole template as the phrase this is exact equality.

    Index words are the rarest anchors: without them the others weigh less than half of all, so
    every copy holds one of them, and common words are never looked up.
    """
    small = (lambda t: F.broadcast(t)) if sum(min(ANCHORS, len(x.words.split(" "))) for x in templates) <= MOST_INDEX_ROWS else (lambda t: t)
    facts = materialize(template_facts(texts, templates))
    rest = F.aggregate(F.slice("anchors", F.col("k") + 1, F.size("anchors")), F.lit(0).cast("long"), lambda s, a: s + a["weight"])
    index = facts.select("*", F.posexplode("anchors").alias("k", "a")).where(2 * rest >= F.col("total")).select("template", "slack", "length", F.col("a.word").alias("word"), F.col("a.tpos").alias("tpos"))
    # the outer form: the inner one makes Spark filter by the size of words, which splits every text again
    words = texts.select("id", "text_hash", words_of(F.col("text")).alias("words"))
    x = words.select("id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "word")).join(small(index), "word")
    start = F.col("pos") - F.col("tpos")
    low = F.greatest(start - F.col("slack"), F.lit(0))
    window = F.slice("words", low + 1, F.greatest(start + F.col("length") + F.col("slack") - low, F.lit(0)))
    # only the words around a start are shuffled; several anchors may propose it
    proposed = x.select("id", "text_hash", "template", start.alias("start"), window.alias("window")).distinct()
    x = proposed.join(small(facts), "template").withColumn("low", F.greatest(F.col("start") - F.col("slack"), F.lit(0)))
    place = lambda a: F.col("start") + a["tpos"] - F.col("low")
    first = lambda a: F.greatest(place(a) - F.col("slack"), F.lit(0))
    near = lambda a: F.array_contains(F.slice("window", first(a) + 1, F.greatest(place(a) + F.col("slack") - first(a) + 1, F.lit(0))), a["word"])
    spelled = F.concat(F.lit(" "), F.array_join("window", " "), F.lit(" "))
    x = x.where(F.forall("phrases", lambda p: F.contains(spelled, F.concat(F.lit(" "), p, F.lit(" ")))))
    x = x.withColumn("found", F.aggregate(F.filter("anchors", near), F.lit(0).cast("long"), lambda s, a: s + a["weight"])).where(2 * F.col("found") >= F.col("total"))
    return x.select("id", "text_hash", "template", "label", "base", F.col("start").cast("long").alias("start"), (F.col("found") / F.col("total")).alias("share"))


def licence_labels(documents: DataFrame, templates: list[LicenceTemplate], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base templates, first_word and last_word are their least and
    greatest start. Labels are distinct, sorted and joined by commas, empty where there is none;
    score is the greatest share of anchor weight of any place, 1 for a base template, else 0.
    Null and empty texts have no words; rows that repeat an id and a text are judged alike, rows
    that repeat an id alone each for themselves, null ids too. An empty library labels nothing.
    Only the named columns are read, others may have any name.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = texts.select("id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = [F.lit(0).cast("long").alias("n_base"), *[F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")], F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")]
    if not templates:
        return rows.select(F.col("id").alias(id_col), "n_words", *none)
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  (as many labels as the library has)
    found = licence_places(texts, templates).groupBy(F.col("id").alias("own"), F.col("text_hash").alias("own_hash")).agg(
        F.count_if("base").alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        names(of_base("label")).alias("base_labels"), names("label").alias("labels"), F.max("share").alias("score"),
    )
    met = rows.join(found, F.col("id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash")), "left")
    filled = [F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score")]
    return met.select(F.col("id").alias(id_col), "n_words", *filled)
