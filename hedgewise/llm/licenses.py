"""Licence scans by a positional index of rare licence words, in DataFrame functions alone.

The templates' words are postings (word, template, position). Of each template the words with the highest IDF over the
whole corpus are looked up in the files, and the places where file and template run side by side are counted by their
relative position. Every one with as many votes as a place must have where enough words agree is read against the whole
template, and a label holds if enough words agree at one of them and all of the template's mandatory phrases stand in the
file.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewise.plans import literal_table, written

#: Words of a template that are looked up, at least.
RARE = 8
#: Votes that a place where enough words agree must have, at least; where RARE words do not warrant them, more are looked up.
LEAST_VOTES = 2
#: Share of a template's words that must stand at their places.
AGREE = 0.6

# What stands between words (in small letters), and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Label, passage of the licence or its usual notice, phrases that it must hold.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed under cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation", ["gnu general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
]

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
#: Every base phrase and every mandatory phrase has one of these words.
KEYS = ["cc", "compliance", "license", "permission", "redistribution"]


def rarest(files: dict[str, int], rare: int, agree: float) -> list[tuple[str, int, int, int]]:
    """(word, template, at, least): the positions of every template's rarest words, and how many of these positions must
    agree wherever a share ``agree`` of the whole template does."""
    rows = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        wording = text.split()
        lost = len(wording) - math.ceil(agree * len(wording) - 1e-9)
        chosen, own = 0, []
        for word in sorted(set(wording), key=lambda w: (files.get(w, 0), w)):
            if chosen >= rare and len(own) >= lost + LEAST_VOTES:
                break
            chosen += 1
            own += [(word, t, i) for i, w in enumerate(wording) if w == word]
        rows += [(*x, max(1, len(own) - lost)) for x in own]
    return rows


def postings(spark: SparkSession, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    return literal_table(spark, "word string, template int, at int, least int", rows)


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, wording, phrases): the words in order, and the mandatory phrases, joined by commas."""
    rows = [(t, label, text, ",".join(phrases)) for t, (label, text, phrases) in enumerate(TEMPLATES)]
    found = literal_table(spark, "template int, label string, wording string, phrases string", rows)
    return found.withColumn("wording", F.split("wording", " "))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after the other."""
    def here(word: Column, i: Column) -> Column:
        whole = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            whole = whole & (F.get(words, i + k) == other)
        return F.when(whole, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def scan(docs: DataFrame, rare: int = RARE, agree: float = AGREE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best share of a template that a label of the method rests on; 0 where there is none. A null or empty
    text has no words and no labels; repeated rows are scanned each for itself; an empty table gives no rows. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    read = docs.select("doc_id", words.alias("words")).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", _strings(VOCABULARY)).alias("seen"),
        F.when(F.arrays_overlap("words", _strings(KEYS)), F.col("words")).alias("words"),
    )
    # written once: the row numbers hold from here on
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "licence-words")
    files = read.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))
    found = {r.word: r.files for r in files.collect()}  # a row per word of the templates
    looked_up = rarest(found, rare, agree)

    open_ones = read.where("words IS NOT NULL")
    votes = (
        open_ones.select("row", F.posexplode("words").alias("pos", "word"))
        .where(F.col("word").isin(sorted({x[0] for x in looked_up})))
        .join(F.broadcast(postings(spark, looked_up)), "word")  # as many rows as the templates have words
        .groupBy("row", "template", "least", (F.col("pos") - F.col("at")).alias("shift"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    shifts = votes.where("votes >= least").groupBy("row", "template").agg(F.collect_list("shift").alias("shifts"))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))

    def agreeing(shift: Column) -> Column:
        same = F.transform("wording", lambda w, i: F.get("words", shift + i) == w)
        return F.size(F.filter(same, lambda x: x))

    judged = (
        shifts.join(F.broadcast(templates(spark)), "template").join(open_ones.select("row", "words"), "row")
        .select(
            "row",
            "label",
            F.forall(F.split("phrases", ","), lambda p: text.contains(F.concat(F.lit(" "), p, F.lit(" ")))).alias("held"),
            (F.array_max(F.transform("shifts", agreeing)) / F.size("wording")).alias("share"),
        )
        .where(F.col("held") & (F.col("share") >= agree))
        .groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))
    )
    places = {label: F.col(f"at_{label}") for label in BASE}
    base = (
        open_ones.select("row", *[_places(F.col("words"), p.split()).alias(f"at_{k}") for k, p in BASE.items()])
        .where(reduce(or_, [F.size(c) > 0 for c in places.values()]))
        .withColumn("every", F.concat(*places.values()))
        .select(
            "row",
            F.size("every").cast("long").alias("n_base"),
            F.array_min("every").cast("long").alias("first_word"),
            F.array_max("every").cast("long").alias("last_word"),
            F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(k)) for k, c in places.items()]), lambda x: x.isNotNull()).alias("base"),
        )
    )
    none = F.array().cast("array<string>")
    base_labels, more = F.coalesce("base", none), F.coalesce("more", none)
    return read.select("row", "doc_id", "n_words").join(base, "row", "left").join(judged, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
