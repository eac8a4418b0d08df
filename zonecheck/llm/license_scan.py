"""License scan by diagonal voting, with DataFrame operations only.

Every word k-gram of a document meets the places of that k-gram in the templates in a join on its hash. A hit at word i
of the document and word j of the template votes for the diagonal i - j. Votes are counted per diagonal; diagonals of a
template that lie within ``slack`` of each other are merged, as words put in or left out shift a match to the next one.
A merged span that covers enough of the template and is not much longer is verified: the document's words there, joined
by spaces, are compared with the template's by edit distance. Templates that are short phrases must match word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import small, stored

#: Characters that are no words: all ASCII but letters and digits. A-Z are still to be lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (label, phrase): these match at every place where the words stand consecutively.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: (label, text): passages of public license texts and notices, matched with gaps.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

K = 2


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def built_in(spark: SparkSession) -> DataFrame:
    """(template, label, exact, text): the phrases and passages above; a table of one's own may be passed instead."""
    rows = [(n, label, n < len(PHRASES), text) for n, (label, text) in enumerate(PHRASES + TEMPLATES)]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, text string")


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def template_grams(templates: DataFrame) -> DataFrame:
    """(template, label, exact, wanted, n_grams, j, w0, w1, gram): a row per k-gram of each template; ``wanted`` is its words joined by spaces. Templates of one word have none."""
    frame = templates.select("template", "label", "exact", words_of(ascii_lower(F.col("text"))).alias("words")).filter(F.size("words") >= K)
    pairs = F.expr(f"transform(sequence(0, size(words) - {K}), j -> struct(j, words[j] as w0, words[j + 1] as w1))")
    frame = frame.select("template", "label", "exact", F.array_join("words", " ").alias("wanted"), (F.size("words") - K + 1).alias("n_grams"), F.explode(pairs).alias("p"))
    return frame.select("template", "label", "exact", "wanted", "n_grams", "p.j", "p.w0", "p.w1", F.xxhash64("p.w0", "p.w1").alias("gram"))


#: First words of k-grams that a first, wide filter takes as a list; with more of them all k-grams go to the join.
FILTER_WORDS = 5000


def scan(documents: DataFrame, templates: DataFrame | None = None, coverage: float = 0.85, slack: int = 2, alike: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows of the documents: doc_id, key, n_words; found spans).

    The first frame has a row for every row of ``documents``, key being the hash of the text. The second has a row per
    span: doc_id, key, template, label, exact, first_word, last_word, covered (share of the template's k-grams), once
    for rows that share doc_id and text. ``templates`` has (template, label, exact, text), ``built_in`` by default.
    Null and empty texts have no words and no spans; a doc_id with several texts has the spans of each. Columns of
    ``documents`` other than doc_id and text are not looked at.
    """
    spark = documents.sparkSession
    grams = stored(template_grams(built_in(spark) if templates is None else templates))
    # lower-cased in all letters on both sides: words that are equal after A-Z are lowered are equal so too
    starts = [r["w0"] for r in grams.select(F.lower("w0").alias("w0")).distinct().limit(FILTER_WORDS + 1).collect()]
    keep = (lambda p: F.lit(True)) if len(starts) > FILTER_WORDS else (lambda p: F.lower(p["a"]).isin(starts))
    documents = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    # each word with its next one; what cannot begin a k-gram of a template stays out of the table
    base = documents.select("doc_id", "key", words_of("text").alias("words"))
    pairs = F.filter(F.transform("words", lambda a, i: F.struct(i.alias("i"), a.alias("a"), F.get("words", i + 1).alias("b"))), keep)
    base = stored(base.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), pairs.alias("pairs")))
    rows = base.select("doc_id", "key", F.explode("pairs").alias("p")).select("doc_id", "key", F.col("p.i").cast("long").alias("i"), ascii_lower(F.col("p.a")).alias("a"), ascii_lower(F.col("p.b")).alias("b"))
    hits = rows.withColumn("h", F.xxhash64("a", "b")).join(small(grams), (F.col("h") == F.col("gram")) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")))
    # a diagonal is one place of one document: its votes are as many as the template has words
    by = ["doc_id", "key", "template", "label", "exact", "n_grams"]
    voted = stored(hits.groupBy(*by, (F.col("i") - F.col("j")).alias("offset")).agg(F.collect_set(F.struct("i", "j")).alias("votes")))
    exact = voted.filter("exact").filter(F.size("votes") == F.col("n_grams")).select(
        "doc_id", "key", "template", "label", "exact", F.col("offset").alias("first_word"), (F.col("offset") + F.col("n_grams")).alias("last_word"), F.lit(1.0).alias("covered")
    )
    one = Window.partitionBy("doc_id", "key", "template").orderBy("offset")
    runs = voted.filter("not exact").withColumn("new", F.when(F.col("offset") - F.lag("offset").over(one) <= slack, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(one))
    merged = runs.select(*by, "run", F.explode("votes").alias("v")).groupBy(*by, "run").agg(
        F.count_distinct("v.j").alias("n_votes"), F.min("v.i").alias("first_word"), (F.max("v.i") + K - 1).alias("last_word")
    )
    near = merged.withColumn("covered", F.col("n_votes") / F.col("n_grams")).filter(
        (F.col("covered") >= coverage) & (F.col("last_word") - F.col("first_word") + 1 <= (F.col("n_grams") + K - 1) + slack * 2)
    )
    return base.select("doc_id", "key", "n_words"), exact.unionByName(verified(documents, near, grams, alike).select(*exact.columns))


def verified(documents: DataFrame, spans: DataFrame, grams: DataFrame, alike: float) -> DataFrame:
    """The ``spans`` whose words in the document are like the template's: an edit distance of at most 1 - ``alike`` of the longer one's characters."""
    wanted = grams.groupBy("template").agg(F.first("wanted").alias("wanted"))
    spans = stored(spans.join(wanted, "template").withColumnsRenamed({"doc_id": "id", "key": "k"}))
    texts = documents.join(small(stored(spans.select("id", "k").distinct().withColumnsRenamed({"id": "i2", "k": "k2"}))), F.col("doc_id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")), "left_semi")
    words = texts.select("doc_id", "key", words_of("text").alias("words")).dropDuplicates(["doc_id", "key"])
    both = spans.join(words, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    found = ascii_lower(F.array_join(F.expr("slice(words, int(first_word + 1), int(last_word - first_word + 1))"), " "))
    longer = F.greatest(F.length("found"), F.length("wanted"))
    return both.withColumn("found", found).filter(F.levenshtein("found", "wanted") <= (1 - alike) * longer)


def scan_documents(documents: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base, spans = scan(documents, templates)
    found = spans.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"), F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    joined = base.join(small(stored(found)), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
