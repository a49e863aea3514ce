"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

The tree's leaves are pieces: sentences of a paragraph (a line), cut at `PIECE` characters counted from the start
of each, as short digests. A paragraph is its leaves followed by the SHA-256 of its text. A section is a run of
paragraphs that ends after one whose hash ends in 0 to 3, so an edit moves section edges only near itself; its
hash digests its paragraphs, and the root digests the hashes of the sections. A fingerprint writes the tree out as
root:section|section, a section's paragraphs each followed by a space.

Equal roots mean equal texts. Otherwise two fingerprints are compared from the top: sections that both have are
done with, then paragraphs that both have, and only below differing paragraphs are leaves compared.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearplane.llm._common import id_quantiles, id_range, order_id, range_of, shuffle_parts

PIECE = 64
LEAF = 8  # hex digits of a leaf
_PIECES = r"[^.!?]{1,%d}[.!?]*|[.!?]+" % PIECE


def paragraphs(text: Column) -> Column:
    """The leaves and the SHA-256 of each line, as one string."""
    piece = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECES), F.lit(0)), lambda x: F.substring(F.md5(x), 1, LEAF))
    return F.transform(F.split(text, "\n"), lambda p: F.concat(F.array_join(piece(p), ""), F.sha2(p, 256)))


def sections(paragraph_strings: Column) -> Column:
    """Runs of paragraphs, each followed by a space."""
    line = F.concat(F.array_join(paragraph_strings, " "), F.lit(" "))
    return F.filter(F.split(F.regexp_replace(line, "([0-3]) ", "$1 |"), "\\|"), lambda s: s != "")


def root(section_strings: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_strings, lambda s: F.sha2(s, 256)), " "), 256)


def fingerprint(text: Column) -> Column:
    tree = lambda s: F.concat(root(s), F.lit(":"), F.array_join(s, "|"))
    return F.transform(F.array(sections(paragraphs(text))), tree)[0]


def branches(print_: Column) -> Column:
    """The sections of a fingerprint."""
    return F.split(F.substring(print_, 66, 1 << 30), "\\|")


def _paragraphs_of(section_strings: Column) -> Column:
    return F.filter(F.flatten(F.transform(section_strings, lambda s: F.split(s, " "))), lambda p: p != "")


def _leaves_of(paragraph_strings: Column) -> Column:
    """The distinct leaves below paragraphs."""
    own = lambda p: F.regexp_extract_all(F.substring(p, F.lit(1), F.length(p) - 64), F.lit("[0-9a-f]{%d}" % LEAF), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(paragraph_strings, own)))


def compare(a: Column, b: Column) -> Column:
    """Struct of two trees, given as sections: near (0 to 1), and the sections and paragraphs of a that b lacks.

    near is the Dice coefficient of the distinct leaves, 1 for equal trees; differing branches are the first eight
    digits of their hashes, ascending. Subtrees that both have are not compared further.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]
    names = lambda hashes: F.array_join(F.array_sort(F.array_distinct(F.transform(hashes, lambda h: F.substring(h, 1, 8)))), ",")

    def below_sections(s: Column) -> Column:
        own, other = _paragraphs_of(s["a"]), _paragraphs_of(s["b"])
        return let(F.struct(F.array_except(own, other).alias("a"), F.array_except(other, own).alias("b"), F.array_intersect(own, other).alias("both"), s["a"].alias("lost"), s["both"].alias("same")), below_paragraphs)

    def below_paragraphs(p: Column) -> Column:
        same = F.array_union(_leaves_of(_paragraphs_of(p["same"])), _leaves_of(p["both"]))
        return let(F.struct(same.alias("same"), _leaves_of(p["a"]).alias("a"), _leaves_of(p["b"]).alias("b"), p["lost"].alias("lost"), p["a"].alias("gone")), likeness)

    def likeness(t: Column) -> Column:
        total = F.size(F.array_union(t["same"], t["a"])) + F.size(F.array_union(t["same"], t["b"]))
        near = 2.0 * F.size(F.array_union(t["same"], F.array_intersect(t["a"], t["b"]))) / total
        return F.struct(F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(near).alias("near"), names(F.transform(t["lost"], lambda x: F.sha2(x, 256))).alias("sections"), names(F.transform(t["gone"], lambda x: F.substring(x, F.length(x) - 63, F.lit(64)))).alias("paragraphs"))

    return let(F.struct(F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"), F.array_intersect(a, b).alias("both")), below_sections)


def merkle_trees(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections, paragraphs of every row; a null text counts as empty, with one empty paragraph."""
    t = docs.select("doc_id", sections(paragraphs(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("s"))
    last = lambda p: F.substring(p, F.length(p) - 63, F.lit(64))
    return t.select("doc_id", root(F.col("s")).alias("root"), F.transform("s", lambda x: F.sha2(x, 256)).alias("sections"), F.transform(_paragraphs_of(F.col("s")), last).alias("paragraphs"))


def ranges(docs: DataFrame, parts: int) -> tuple[list[int], dict[int, int]]:
    """Ascending cut points of doc_id, and how many ranges an id gets that several cut points fall on."""
    cuts = id_quantiles(docs.select(order_id().alias("oid")), parts, "oid")
    return sorted(set(cuts)), {c: n for c, n in Counter(cuts).items() if n > 1}


def with_next(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text with next_text, the text of the next row by doc_id (the first one's after the last).

    Ids are cut into ranges of nearly equal row counts, and an id with many rows by the hashes of its texts. Each
    range also gets a copy of the first row behind it, so the next row is always in the same window, and texts are
    shuffled once. Rows of one id are ordered by the hash of their text; equal rows stay together.
    """
    spark = docs.sparkSession
    bounds, often = ranges(docs, 4 * shuffle_parts(spark))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), order_id().alias("oid"), F.md5(text).alias("hash"))
    sub = F.lit(0)
    for id_, n in often.items():  # at most one for each two cut points
        own = F.floor(F.conv(F.substring("hash", 1, 4), 16, 10).cast("long") * n / 65536)
        sub = F.when(F.col("oid") == F.lit(id_), own).when((F.col("oid") > F.lit(id_)) & (id_range(bounds, F.col("oid")) == F.lit(range_of(bounds, id_))), F.lit(n)).otherwise(sub)
    rows = rows.withColumn("range", id_range(bounds, F.col("oid")) * F.lit(1 << 20).cast("long") + sub)
    # at most two rows for each cut point
    least = rows.groupBy("range").agg(F.min("oid").alias("oid")) if not often else rows.groupBy("range").agg(F.min(F.struct("oid", "hash")).alias("m")).select("range", "m.oid", "m.hash")
    firsts = least.orderBy("range").collect()
    if not firsts:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    guests = [(r["oid"], r["hash"] if often else None, firsts[i - 1]["range"], i == 0) for i, r in enumerate(firsts)]
    sent = F.broadcast(spark.createDataFrame(guests, "first long, first_hash string, to long, wrapped boolean"))
    match = (F.col("oid") == F.col("first")) & (F.col("first_hash").isNull() | (F.col("hash") == F.col("first_hash")))
    copies = rows.join(sent, match).select("doc_id", "text", "oid", "hash", F.col("to").alias("range"), "wrapped", F.lit(True).alias("guest"))
    both = rows.select("doc_id", "text", "oid", "hash", "range", F.lit(False).alias("wrapped"), F.lit(False).alias("guest")).union(copies)
    by = Window.partitionBy("range").orderBy("wrapped", "oid", "hash")
    return both.withColumn("next_text", F.lead("text").over(by)).where("not guest").select("doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the first as many
    (or all) of the next row by doc_id. One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and edited_sections and edited_paragraphs, the branches of the text
    that the edited text lacks. A null text counts as empty; rows that repeat an id are ordered by the
    hash of their text; a null id sorts first; a lone row is its own next; an empty table gives no rows. Other columns are not read.
    """
    t = with_next(docs).withColumn("n_chars", F.length("text"))
    cut = F.expr("n_chars div 4").cast("int")
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    t = t.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(fingerprint(F.col(c)).alias(n) for c, n in (("text", "fp"), ("edited", "edited_fp"), ("next_text", "next_fp"))))
    t = t.withColumns({"at_edited": compare(branches(F.col("fp")), branches(F.col("edited_fp"))), "at_next": compare(branches(F.col("fp")), branches(F.col("next_fp")))})
    return t.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), F.col("at_edited.near").alias("near_edited"), F.col("at_next.near").alias("near_next"), F.col("at_edited.sections").alias("edited_sections"), F.col("at_edited.paragraphs").alias("edited_paragraphs"))
