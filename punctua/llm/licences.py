"""Licence scan: positional rare-token index over word arrays, in DataFrame functions only.

Every template (a label and its mandatory key phrase) is posted under the phrase's rarest
words, by document frequency over the whole table. A file looks up its own words in that
index, the offsets of the rarest word are intersected with the next rarest words by relative
position, and what is left is verified against the whole key phrase. A file that holds a
phrase holds its rare words at these positions, so the result is exactly the places of the
phrases, whichever words are rare. Nothing is shuffled but one count per licence word.

Defined cases: null and empty texts have no words, 0 places, null positions, empty labels and
score 0. Repeated rows give repeated results. Other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = {
    "apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl-1.0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc0 1 0": "cc0",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "permission to use copy modify and or distribute this software": "isc",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def words_of(text: str) -> Column:
    """The words of a text column, A-Z in lower case."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, NOT_WORD), "")



def document_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each vocabulary word occurs; the vocabulary bounds the result."""
    found = F.array_intersect(words_of(text), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def _places(number: int, words: list[str], rare: list[int]) -> Column:
    """Array of (start, phrase number) where the phrase stands, from the array column hits."""
    first, *others = rare

    def verified(start: Column) -> Column:
        ok = start >= 0
        for i in others:  # intersection by relative position
            ok = ok & (F.get(F.col("words"), start + i) == words[i])
        whole = F.slice(F.col("words"), start + 1, len(words)) == F.array(*map(F.lit, words))
        return F.when(ok, whole).otherwise(False)

    hits = F.filter("hits", lambda h: h["word"] == words[first])
    starts = F.filter(F.transform(hits, lambda h: h["at"] - first), verified)
    return F.transform(starts, lambda s: F.struct(
        s.cast("long").alias("start"), F.lit(number).alias("phrase")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES,
         rare_words: int = 3) -> DataFrame:
    """One row per document: n_words, places and labels; see the module for defined cases.

    ``places`` lists (start, phrase) of every key phrase found. ``rare_words`` is how many of a
    phrase's rarest words are intersected before the whole phrase is verified.
    """
    phrases = list(base.items()) + list(templates.items())
    listed = [phrase.split() for phrase, _ in phrases]
    vocabulary = sorted({w for words in listed for w in words})
    known = document_frequency(docs, text, vocabulary)

    def by_rarity(words: list[str]) -> list[int]:
        return sorted(range(len(words)), key=lambda i: (known.get(words[i], 0), i))[:rare_words]

    rare = [by_rarity(words) for words in listed]
    keys = sorted({listed[k][r[0]] for k, r in enumerate(rare)})
    table = docs.select(F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    numbered = F.transform("words", lambda w, i: F.when(w.isin(keys), F.struct(
        i.cast("int").alias("at"), w.alias("word"))))
    table = table.withColumn("hits", F.filter(numbered, lambda h: h.isNotNull()))
    places = [_places(k, words, rare[k]) for k, words in enumerate(listed)]
    label_of = F.array(*[F.lit(label) for _, label in phrases])
    table = table.withColumn("places", F.when(F.size("hits") > 0, F.concat(*places)).otherwise(
        F.array().cast("array<struct<start:bigint,phrase:int>>")))
    own = F.filter("places", lambda p: p["phrase"] < len(base))
    starts = F.transform(own, lambda p: p["start"])

    def labels(of: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(of, lambda p: F.get(label_of, p["phrase"]))))

    table = table.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(own).alias("base"), labels(F.col("places")).alias("all"), "places")
    return table.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join("all", ",").alias("labels"),
        (F.size("all") / (F.size("all") + 1.0)).alias("score"), "places")


def oracle() -> str:
    """The same rows in DuckDB, without an index: the text is cut at every phrase.

    Words are joined by two spaces, so that neighbouring places share no character. No phrase
    overlaps itself.
    """
    def parts(phrase: str) -> str:
        return f"string_split(joined, ' {'  '.join(phrase.split())} ')"

    def count(part: str) -> str:
        return f"len(list_filter(string_split({part}, ' '), lambda x: x <> ''))"

    cut = ", ".join(f"{parts(p)} AS p{k}" for k, p in enumerate([*BASE, *TEMPLATES]))
    first = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN {count(f'p{k}[1]')} END"
                      for k in range(len(BASE)))
    last = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN n - {count(f'p{k}[-1]')} - {len(p.split())} END"
                     for k, p in enumerate(BASE))
    places = " + ".join(f"len(p{k}) - 1" for k in range(len(BASE)))

    def labels(n: int) -> str:
        some = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN '{x}' END"
                         for k, x in enumerate([*BASE.values(), *TEMPLATES.values()][:n]))
        return f"list_sort(list_distinct(list_filter([{some}], lambda x: x IS NOT NULL)))"

    return f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') AS words FROM documents),
    j AS (SELECT doc_id, len(words) AS n, ' ' || array_to_string(words, '  ') || ' ' AS joined
        FROM w),
    f AS (SELECT doc_id, n, {cut} FROM j),
    l AS (SELECT *, {labels(len(BASE))} AS base, {labels(len(BASE) + len(TEMPLATES))} AS every
        FROM f)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST({places} AS BIGINT) AS n_base,
        CAST(list_min([{first}]) AS BIGINT) AS first_word,
        CAST(list_max([{last}]) AS BIGINT) AS last_word,
        array_to_string(base, ',') AS base_labels, array_to_string(every, ',') AS labels,
        len(every) / (len(every) + 1.0) AS score FROM l"""


def op4_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")
