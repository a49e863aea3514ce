"""Language identification by compression with per-language zstandard raw-content dictionaries.

The text, lower-cased with everything but letters reduced to single spaces, is compressed once per
language with that language's dictionary; the smallest size wins, and a decision with a narrow margin is
flagged as rejected. Training reads at most `SAMPLE_DOCS` documents per language, those with the smallest
seeded hashes, and of these, in that order, the first `DICT_BYTES` characters in all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearplane.llm._common import memory_returned

SAMPLE_DOCS = 96
DICT_BYTES = 96 << 10
MARGIN = 0.01  # of the second smallest size; below it the decision is flagged
LEVEL = 3
SCALE = 4.0  # bytes of difference that change the odds by a factor e


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """If crc32 of doc_id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train_dictionaries(labelled: DataFrame, seed: int = 7) -> dict[str, bytes]:
    """lang -> dictionary content from rows (doc_id, text, lang).

    Rows with a null lang, or a null or empty text, teach nothing. Rows are told apart by doc_id and text, so repeats
    count once; ties of the hash go by id, then text. A language of long texts only is learned from their beginnings.
    The driver gets DICT_BYTES characters a language.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("th"), "text")
    keys = rows.select("lang", "id", "th", F.length("text").alias("n"), F.xxhash64("id", "lang", F.lit(seed)).alias("h"))
    # hashes spread evenly, so the smallest SAMPLE_DOCS of a language are under a bound that few others are under
    many = keys.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("id", "th")).alias("docs")).collect()  # a row a language
    bound = F.lit(8.0 * SAMPLE_DOCS) / F.col("docs") * float(1 << 63)
    keys = keys.join(F.broadcast(spark.createDataFrame(many, "lang string, docs long")), "lang").where(F.shiftrightunsigned("h", 1).cast("double") <= bound).select("lang", "id", "th", "n", F.shiftrightunsigned("h", 1).alias("h")).distinct()
    order = Window.partitionBy("lang").orderBy("h", "id", "th")
    first = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("room", F.lit(DICT_BYTES) - before).where("room > 0").select("lang", "id", "th", "r", "room").collect()  # SAMPLE_DOCS small rows per language
    found = rows.join(F.broadcast(spark.createDataFrame(chosen, "lang string, id string, th long, r int, room long")), ["lang", "id", "th"])
    texts = found.groupBy("lang", "r").agg(F.min(F.expr("substring(text, 1, room)")).alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(letters_only(r["text"]).encode())
    return {lang: b"\n".join(held)[:DICT_BYTES] for lang, held in out.items()}


_OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    return _OTHER.sub(" ", text.lower())


_compressors: dict[str, tuple[list[str], list]] = {}


def _classify(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    import zstandard as zs

    name, dictionaries = model.value
    if name not in _compressors:
        _compressors.clear()
        langs = sorted(dictionaries)
        made = []
        for lang in langs:
            d = zs.ZstdCompressionDict(dictionaries[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zs.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors[name] = langs, made
    langs, made = _compressors[name]
    for b in batches:
        letters = pc.fill_null(pc.match_substring_regex(b.column(1), r"\p{L}"), False).to_pylist()
        pred, score, margin, rejected = [], [], [], []
        for text, ok in zip(b.column(1).to_pylist(), letters, strict=True):
            if not ok or not langs:
                pred.append("und"), score.append(0.0), margin.append(0.0), rejected.append(True)
                continue
            data = letters_only(text).encode()
            size = [len(c.compress(data)) for c in made]
            best = int(np.argmin(size))
            rest = [s - size[best] for i, s in enumerate(size) if i != best]
            gap = min(rest) / (min(rest) + size[best]) if rest else 1.0
            pred.append(langs[best])
            score.append(1.0 / (1.0 + sum(np.exp(-min(x / SCALE, 50.0)) for x in rest)))
            margin.append(gap)
            rejected.append(gap < MARGIN)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], held: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, margin, rejected.

    lang_pred is the language whose dictionary compresses the whole text best (ties: the first by name), or
    `und` with score 0 if the text is null or has no letter. rejected flags a gap to the runner-up under
    `MARGIN` of its size. Only the text is looked at. Repeated rows each give a row; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast((uuid4().hex, dictionaries))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if held is None else held).alias("held_out"))
    return rows.mapInArrow(memory_returned(lambda it: _classify(it, model)), "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")
