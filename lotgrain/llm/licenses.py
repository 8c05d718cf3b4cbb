"""License scans by diagonal voting, in DataFrame functions only.

Words of every text become rolling two-word hashes. They are joined to the positions of the
same hashes in a few license templates (a fixed list, so its side is broadcast). A hit votes
for its diagonal, the document position minus the template position: an unchanged copy of a
template puts all votes on one diagonal, and an inserted or missing word moves the rest to a
neighbouring one. Votes are counted per diagonal, diagonals at most ``DRIFT`` apart whose
stretches lie close together merge into one span. Every hit is verified on its two words, and a
span of a wording has to hold the pairs that tell it from other wordings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Longer wordings, their labels, and the share of word pairs that must be found.
WORDINGS = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-grant"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
]
SHARE = 0.75

# The words of a wording that tell it from others; a span without one of these pairs is none of it.
DECIDING = {
    "apache-2.0": ["apache license", "version 2"],
    "mit-notice": ["mit license"],
    "mit-grant": ["hereby granted"],
    "gpl-3": ["gnu general", "general public", "version 3"],
    "gpl-2": ["gnu general", "general public", "version 2"],
    "bsd": ["are permitted"],
    "mpl": ["mozilla public"],
    "cc-by": ["cc by", "by 4"],
    "cc-by-sa": ["cc by", "by sa", "sa 4"],
    "cc-by-nc": ["cc by", "by nc", "nc 4"],
    "all-rights-reserved": ["all rights", "rights reserved"],
}
#: Diagonals of one span differ by at most this many words; so do the gaps between its stretches.
DRIFT = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every ASCII character that is no digit or letter stands between words.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: str | Column) -> Column:
    """Lower-cased words of digits, letters and non-ASCII characters: one translation, and a split at single spaces."""
    plain = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def pair_hashes(words: Column) -> Column:
    """The hash of each word and the next; the last word has no pair."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    tails = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(heads, tails, lambda a, b: F.xxhash64(a, b))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, is_base, template_words, deciding, t_pos, pair) for every word pair of every template.

    ``deciding`` has the positions of the pairs that a span must hold.
    """
    rows = []
    for i, (phrase, label, kind) in enumerate([(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in WORDINGS]):
        words = phrase.split()
        pairs = [" ".join(words[k : k + 2]) for k in range(len(words) - 1)]
        rows.append((i, label, kind, words, [] if kind else [pairs.index(p) for p in DECIDING[label]]))
    named = spark.createDataFrame(rows, "template int, label string, is_base boolean, template_words array<string>, deciding array<int>")
    return named.select("*", F.posexplode(pair_hashes(F.col("template_words"))).alias("t_pos", "pair"))


def _verified(spans: DataFrame) -> DataFrame:
    """Exact words for base phrases, a sufficient share of the word pairs and all deciding ones for wordings."""
    length = F.size("template_words")
    exact = F.col("is_base") & (F.col("span_words") == F.col("template_words"))
    decided = F.size(F.array_except("deciding", "found")) == 0
    return (
        spans.withColumn("share", F.size("found") / (length - 1))
        .where(exact | (~F.col("is_base") & (F.col("share") >= SHARE) & decided))
        .drop("span_words", "template_words", "deciding", "found")
    )


def find_licenses(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per verified place: the key, label, is_base, first_word, last_word, share.

    ``key`` names columns that tell documents apart; null keys are kept apart from no other null.
    ``first_word`` is where the span starts (words from 0), ``last_word`` its last word. Rows
    that agree in key and text give the same places once. Texts without words give none.
    """
    words = docs.select(*key, F.xxhash64(text).alias("_text"), words_of(text).alias("_words"))
    pairs = words.select(*key, "_text", "_words", F.posexplode(pair_hashes(F.col("_words"))).alias("d_pos", "pair"))
    known = F.broadcast(templates(docs.sparkSession))
    same_words = F.slice("_words", F.col("d_pos") + 1, 2) == F.slice("template_words", F.col("t_pos") + 1, 2)
    hits = pairs.join(known, "pair").where(same_words).select(
        *key, "_text", "template", "label", "is_base", "template_words", "deciding", "t_pos", "d_pos",
        (F.col("d_pos") - F.col("t_pos")).alias("diagonal"),
        # As many words as a template has, from where this hit puts its start: for verification.
        F.slice("_words", F.greatest(F.col("d_pos") - F.col("t_pos") + 1, F.lit(1)), F.size("template_words")).alias("span_words"),
    )
    by = [*key, "_text", "template"]
    kept = ["label", "is_base", "template_words", "deciding"]
    votes = hits.groupBy(*by, "diagonal").agg(
        *[F.any_value(c).alias(c) for c in kept],
        F.collect_set("t_pos").alias("votes"),
        F.min("d_pos").alias("start"),
        F.max("d_pos").alias("end"),
        F.any_value("span_words").alias("span_words"),
    )
    # Wordings: a stretch that starts soon behind another on a near diagonal belongs to it.
    # A base phrase stands in one piece, so each of its diagonals is a span.
    order = Window.partitionBy(*by).orderBy("start", "diagonal")
    new = F.coalesce(
        F.col("is_base")
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT)
        | (F.col("start") - F.lag("end").over(order) > DRIFT + 1),
        F.lit(True),
    )
    spans = (
        votes.withColumn("_new", new.cast("int"))
        .withColumn("span", F.sum("_new").over(order))
        .groupBy(*by, "span")
        .agg(
            *[F.any_value(c).alias(c) for c in kept],
            F.array_distinct(F.flatten(F.collect_list("votes"))).alias("found"),
            F.min("start").alias("first_word"),
            (F.max("end") + 1).alias("last_word"),
            F.any_value("span_words").alias("span_words"),
        )
    )
    return _verified(spans).drop("template", "span")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, null
    without one. Labels are distinct, sorted and joined by commas, empty if there are none.
    ``score`` is 1 with a base phrase, else the largest share of a wording's pairs found, else
    0. A null text counts as empty. Repeated rows each get the same result.
    """
    found = find_licenses(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    start = F.when(F.col("is_base"), F.col("first_word"))
    summary = found.groupBy("doc_id", "_text").agg(
        F.count(start).alias("n_base"),
        F.min(start).cast("long").alias("first_word"),
        F.max(start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("share"),
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("_text"),
        F.size(words_of(text)).cast("long").alias("n_words"),
    ).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._text") == F.col("s._text"))
    return rows.join(summary.alias("s"), same, "left").select(
        "d.doc_id",
        "d.n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
