"""License scan by diagonal voting, in DataFrame operations only.

Templates and documents become rolling word k-grams. Every k-gram of every document is joined, by its hash, to the
template positions that have it; a hit votes for the diagonal, that is the place at which the template would start. Votes
of a diagonal are summed as bit masks of template positions, one for each SLOT positions, so that repeated rows change nothing and templates may have any length. Neighbouring
diagonals of one template, which a word put in or left out makes, merge into a span. A span counts if the
positions that it covers make up enough of the template; a base phrase needs all of them on a single diagonal, which are then
its words one after another.

A second hash of each k-gram has to agree as well, so that a hit is the template's words with 96 bits of certainty.

Defined results: a null text has no word; a document without a span has 0 places, null positions, empty labels and
score 0; repeated rows get equal results; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Template positions in one mask.
SLOT = 63


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: All words in a row, exactly.
    base: bool = False
    #: Share of its k-grams that a span must cover.
    share: float = 0.7


BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))
OWN = (
    Template("mit", "released under the mit license"),
    Template("apache-2.0", "licensed under the apache license version 2"),
    Template("cc-by-nc", "licensed under cc by nc", share=1.0),
    Template("cc-by-sa", "licensed under cc by sa", share=1.0),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-3", "free software foundation either version 3 of the license or at your option any later version"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: str | Column) -> Column:
    """Words of the lower-cased text. U+212A, the one other character whose lower case is in a-z, is kept out of a-z."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.lower(F.replace(c, F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def _grams(ws: Column) -> Column:
    """A struct of two hashes for each K words in a row; K is 2."""
    pair = lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1)).alias("h"), F.hash(F.get(ws, i + 1), w).alias("c"))
    return F.slice(F.transform(ws, pair), F.lit(1), F.greatest(F.size(ws) - (K - 1), F.lit(0)))


def template_rows(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """tid, label, base, share, grams (their number), tpos, h, c."""
    rows = [(i, t.label, t.base, t.share, t.words.split()) for i, t in enumerate(templates)]
    for _, label, _, _, ws in rows:
        if len(ws) < K:
            raise ValueError(f"a template of {label} has {len(ws)} words; a k-gram has {K}")
    df = spark.createDataFrame(rows, "tid int, label string, base boolean, share double, ws array<string>")
    df = df.withColumn("grams", F.size("ws") - (K - 1))
    return df.select("tid", "label", "base", "share", "grams", F.posexplode(_grams(F.col("ws"))).alias("tpos", "g")).select("tid", "label", "base", "share", "grams", "tpos", "g.h", "g.c")


def _votes(docs: DataFrame, templates: tuple[Template, ...], broadcast_rows: int) -> DataFrame:
    """By document (doc_id, text_hash, n_words), template, diagonal and slot: the mask of its votes, where they start and how many there are.

    Every document begins with one gram that no words make and that meets a template of its own (tid -1), so that
    documents without a hit stay and the text is read and cut into words once; its votes are the rows that are alike.
    """
    spark = docs.sparkSession
    rows = template_rows(spark, templates).unionByName(spark.createDataFrame([(-1, None, False, 2.0, 1, 0, 0, None)], "tid int, label string, base boolean, share double, grams int, tpos int, h long, c int"))
    n = sum(len(t.words.split()) - (K - 1) for t in templates)
    if n <= broadcast_rows:
        rows = F.broadcast(rows)
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words("text").alias("ws"))
    first = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(None).cast("int").alias("c")))
    grams = own.select("doc_id", "text_hash", F.size("ws").cast("long").alias("n_words"), F.posexplode(F.concat(first, _grams(F.col("ws")))).alias("pos", "g"))
    grams = grams.select("doc_id", "text_hash", "n_words", (F.col("pos") - 1).alias("pos"), F.col("g.h").alias("gh"), F.col("g.c").alias("gc"))
    hits = grams.join(rows, (F.col("gh") == F.col("h")) & F.col("gc").eqNullSafe(F.col("c")))
    slot = F.floor(F.col("tpos") / SLOT).cast("int").alias("slot")
    return hits.groupBy(*KEY, (F.col("pos") - F.col("tpos")).alias("diagonal"), slot).agg(F.bit_or(F.expr(f"shiftleft(1L, tpos % {SLOT})")).alias("mask"), F.min("pos").alias("start"), F.count("*").alias("votes"))


KEY = ["doc_id", "text_hash", "n_words", "tid", "label", "base", "share", "grams"]
DOC = ["doc_id", "text_hash", "n_words"]


def spans(docs: DataFrame, templates: tuple[Template, ...], near: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Verified spans: doc_id, text_hash, n_words, label, base, start (word, from 0), covered (share of the template), and a row of null label for each document, with `rows` of it.

    near: diagonals this close merge. broadcast_rows: up to so many template positions are sent to all executors; beyond, the join shuffles.
    """
    votes = _votes(docs, templates, broadcast_rows)
    # A run of diagonals of one template and document, each near the one before it, is one span; a base phrase has one diagonal.
    w = Window.partitionBy("doc_id", "text_hash", "tid").orderBy("diagonal", "slot")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    gap = F.coalesce(step > F.when(F.col("base"), 0).otherwise(near), F.lit(True))
    merged = votes.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(w))
    merged = merged.groupBy(*KEY, "run", "slot").agg(F.bit_or("mask").alias("mask"), F.min(F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("start"))).cast("long").alias("start"), F.min("votes").alias("rows"))
    merged = merged.groupBy(*KEY, "run").agg(F.sum(F.bit_count("mask")).alias("hit"), F.min("start").alias("start"), F.min("rows").alias("rows"))
    merged = merged.withColumn("covered", F.col("hit") / F.col("grams"))
    return merged.where((F.col("tid") < 0) | (F.col("covered") >= F.when(F.col("base"), 1.0).otherwise(F.col("share")))).select(*DOC, "tid", "label", "base", "start", "covered", "rows")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(labels)), ",")


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + OWN) -> DataFrame:
    """One row for each of docs (doc_id, text): places of base phrases, labels and score."""
    base = F.col("base")
    by_text = spans(docs, templates).groupBy(*DOC).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"), _joined(F.col("label")).alias("labels"), F.max(F.when(F.col("tid") >= 0, F.col("covered"))).alias("score"), F.max(F.when(F.col("tid") < 0, F.col("rows"))).alias("rows"),
    )
    # Rows that are alike were counted as one; they come out as often as they came in.
    return by_text.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy")).drop("copy")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.share}::DOUBLE, string_split('{t.words}', ' '))" for i, t in enumerate(BASE + OWN))


OP5_SQL = rf"""
WITH t(tid, label, base, share, ws) AS (VALUES {_values()}),
g AS (SELECT tid, label, base, share, len(ws) - 1 AS grams, unnest(range(0, len(ws) - 1)) AS tpos, ws FROM t),
p AS (SELECT tid, label, base, share, grams, tpos, ws[tpos + 1] AS a, ws[tpos + 2] AS b FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), chr(312))), '{WORD}') AS ws FROM documents),
q AS (SELECT r, unnest(range(0, greatest(len(ws) - 1, 0))) AS pos, ws FROM d),
h AS (SELECT r, pos, ws[pos + 1] AS a, ws[pos + 2] AS b FROM q),
v AS (SELECT r, tid, label, base, share, grams, pos - tpos AS diagonal, bit_or(1::BIGINT << tpos::INT) AS mask, min(pos) AS start FROM h JOIN p USING (a, b) GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > 3 THEN 1 ELSE 0 END AS gap FROM v WHERE NOT base WINDOW w AS (PARTITION BY r, tid ORDER BY diagonal)),
n AS (SELECT *, sum(gap) OVER (PARTITION BY r, tid ORDER BY diagonal) AS run FROM m),
s AS (SELECT r, label, base, diagonal AS start, 1.0::DOUBLE AS covered FROM v WHERE base AND bit_count(mask) = grams
  UNION ALL SELECT r, label, base, min(start), bit_count(bit_or(mask))::DOUBLE / grams FROM n GROUP BY r, tid, label, base, share, grams, run HAVING bit_count(bit_or(mask))::DOUBLE / grams >= share),
f AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM s GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN f USING (r)
"""
