"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of training text. A text is
compressed once per language and takes the language whose dictionary makes it smallest. The
whole text is read, in segments, so that a long text cannot replace the dictionary by its own
beginning. The score is the relative margin to the next language; below ``least_margin`` the
row is marked as rejected.

The dictionaries are a bounded sample: about ``sample_rows`` distinct texts per language,
``piece_chars`` from the middle of each, ``dictionary_bytes`` at most. Prediction covers all
rows and reads nothing but the text.

Defined cases: a null text, an empty text and a text without a letter are ``und`` with score 0.
With no training rows every text is ``und``. With one language its texts get score 1. Equal
sizes go to the language that sorts first. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SEGMENT = 8192


def held_out(doc_id: str | Column) -> Column:
    """Rows that no fit may see: crc32 of the id's text leaves 2 in a division by 4."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 96,
        piece_chars: int = 2000, dictionary_bytes: int = 64 * 1024) -> dict[str, bytes]:
    """Language -> dictionary content, from a sample of ``sample_rows`` texts per language.

    Texts are drawn by their hash and copies count once, so a large group of copies neither
    fills a dictionary nor the driver.
    """
    table = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(
        F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items()
                           for x in (k, min(1.0, sample_rows / max(n, 1)))])
    drawn = (F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - piece_chars / 2).cast("int"))
    picked = table.where(drawn).groupBy("lang", "h").agg(
        F.min(F.substring("text", middle, F.lit(piece_chars))).alias("piece"))
    pieces: dict[str, list] = {k: [] for k in sorted(sizes)}
    for r in picked.collect():
        pieces[r["lang"]].append((r["h"], r["piece"]))
    return {k: "\n".join(p for _, p in sorted(v)).lower().encode()[:dictionary_bytes]
            for k, v in pieces.items()}


def compressors(model: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    found = []
    for name in sorted(model):
        if len(model[name]) < 8:  # too short for a dictionary
            continue
        known = zstandard.ZstdCompressionDict(
            model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level)
        found.append((name, zstandard.ZstdCompressor(
            dict_data=known, write_content_size=False, write_checksum=False,
            write_dict_id=False, level=level)))
    return found


def best_of(text: str | None, known: list) -> tuple[str, float]:
    """The language that makes the whole text smallest, and its relative margin."""
    if not text or not known or not LETTER.search(text):
        return UNKNOWN, 0.0
    data = text.lower().encode("utf-8", "replace")
    parts = [data[i:i + SEGMENT] for i in range(0, len(data), SEGMENT)]
    sizes = [sum(len(c.compress(p)) for p in parts) for _, c in known]
    if len(sizes) == 1:
        return known[0][0], 1.0
    first, second = np.argsort(sizes, kind="stable")[:2]
    return known[first][0], float((sizes[second] - sizes[first]) / sizes[second])


def predict(docs: DataFrame, model: dict[str, bytes], doc_id: str = "doc_id",
            text: str = "text", least_margin: float = 0.02, level: int = 6) -> DataFrame:
    """doc_id, lang_pred, score and rejected (a narrow margin) of every row.

    The model is part of the task; its size is bounded by languages x ``dictionary_bytes``.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = compressors(model, level)
        for batch in batches:
            found = [best_of(t.as_py(), known) for t in batch.column("text")]
            names, scores = [n for n, _ in found], [s for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()),
                 pa.array([s < least_margin for s in scores], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return table.mapInArrow(
        run, f"doc_id {kind.simpleString()}, lang_pred string, score double, rejected boolean")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
