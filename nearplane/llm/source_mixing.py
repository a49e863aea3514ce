"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain - language - source. A node's supply is its tokens times `epochs`. Going down, a node's
budget is dealt to its children by weight; a child that cannot fill its share takes all it has, and the
rest goes to its siblings by their weights. As budgets never exceed supplies, a shortage is settled among
siblings first and reaches the parent's siblings only when the whole parent falls short.

Each leaf then takes whole epochs and the token prefix of one more, in an order by a seeded hash of that
epoch and the id, then by text, then by row. The row that holds the cut is found by token sums of ever
finer parts of the order: hash buckets, ids of one bucket, buckets of texts of one id, texts, and partitions
of rows that are equal. No step gathers rows, so neither a leaf, an id, a text nor the null id that has most
rows of the corpus is a single task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearplane.llm._common import stored

LEVELS = ["domain", "lang", "source"]
NONE = "(none)"  # stands for a null language or source
BUCKET_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def default_domain(source: Column) -> Column:
    """domain0 to domain3 by the number that ends a source's name, domain? without one."""
    n = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.coalesce(F.concat(F.lit("domain"), (n.try_cast("long") % 4).cast("string")), F.lit("domain?"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent keys, name, budget of the parent, supply, w) with each node's share, in whole tokens."""
    group = Window.partitionBy(*parent)
    by = group.orderBy((F.col("supply") / F.col("w")), name)
    before = F.coalesce(F.sum("supply").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumns({"before": before, "after": after})
    nodes = nodes.withColumn("full", (F.col("budget") - F.col("before")) * F.col("w") >= F.col("supply") * F.col("after"))
    open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    nodes = nodes.withColumns({"left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(group), "all_w": F.sum(open_w).over(group), "upto": F.sum(open_w).over(group.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    nodes = nodes.withColumn("share", F.when(F.col("full"), F.col("supply")).otherwise(F.expr("left * upto div all_w - left * (upto - w) div all_w")))
    return nodes.drop("before", "after", "full", "left", "all_w", "upto", "budget")


def keyed(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs as a struct, row, with the tree's keys, word counts, and a row's name: id, text_md5 and a number, rid."""
    names = {"domain": default_domain(F.col("source")) if domain is None else domain, "lang": F.coalesce("lang", F.lit(NONE)), "source": F.coalesce("source", F.lit(NONE))}
    return docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(n) for n, c in names.items()), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"), F.monotonically_increasing_id().alias("rid"))


def _order(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("id")))


def _cut(parts: DataFrame, by: str, *more: Column) -> DataFrame:
    """Of parts (tree's keys, left, by, s): the first of each leaf, in the order of by, that reaches `left` tokens, with what is left there."""
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*LEVELS).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = parts.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("s") >= F.col("left")))
    return at.select(*LEVELS, by, *more, (F.col("left") - F.col("before")).alias("left"))


def mixing_plan(rows: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, epochs: int, seed: int) -> DataFrame:
    """For each leaf that gets tokens: its budget, whole epochs, and the last row and its tokens of the partial epoch.

    rows are stored keyed() rows with n_tokens, id, text_md5, rid and the tree's keys.
    """
    leaf = rows.where("n_tokens > 0").groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaf = leaf.withColumn("supply", F.col("tokens") * epochs)
    for depth, level in enumerate(LEVELS):
        leaf = leaf.withColumn(f"w{depth}", _weight(level, weights)).where(F.col(f"w{depth}") > 0)
    leaf = stored(leaf, "leaves")
    total = leaf.agg(F.sum("tokens").alias("tokens"), F.sum("supply").alias("supply"))
    nodes = total.select(F.least("supply", F.floor(F.col("tokens") * F.lit(share)).cast("long")).alias("share"))
    for depth, level in enumerate(LEVELS):
        above, own = LEVELS[:depth], LEVELS[: depth + 1]
        children = leaf.groupBy(*own).agg(F.sum("supply").alias("supply"), F.first(f"w{depth}").alias("w"))
        children = children.join(nodes.withColumnRenamed("share", "budget"), above) if above else children.crossJoin(nodes.withColumnRenamed("share", "budget"))  # one row
        nodes = _deal(children, above, level).select(*own, "share")
    plan = leaf.join(nodes, LEVELS).where("share > 0").withColumn("whole", F.expr("share div tokens"))
    plan = plan.withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
    plan = stored(plan.withColumn("bits", F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / BUCKET_ROWS))).cast("int")).select(*LEVELS, "tokens", "share", "whole", "rest", "bits"), "plan")
    return stored(plan.join(_last_rows(rows, plan, seed), LEVELS, "left").select(*LEVELS, "share", "whole", "last_key", "last_text", "last_rid", "last_tokens"), "plan")


def _last_rows(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Of each leaf with a partial epoch, the row that holds its cut: last_key, last_text, last_rid, and last_tokens of it."""
    part = rows.where("n_tokens > 0").join(plan.where("rest > 0").withColumnRenamed("rest", "left"), LEVELS).select(*LEVELS, "n_tokens", "left", _order(seed, F.col("whole")).alias("key"), "text_md5", "rid", "bits")
    part = part.withColumn("bucket", F.expr("shiftright(bigint(conv(substr(key, 1, 8), 16, 10)), 32 - bits)")).drop("bits")
    summed = lambda df, *by: df.groupBy(*LEVELS, "left", *by).agg(F.sum("n_tokens").alias("s"))
    cut = _cut(summed(part, "bucket"), "bucket")
    near = stored(part.drop("left").join(cut, [*LEVELS, "bucket"]).drop("bucket"), "cuts")
    cut = _cut(summed(near, "key"), "key")
    same_id = near.drop("left").join(cut, [*LEVELS, "key"]).withColumn("chunk", F.substring("text_md5", 1, 4))
    cut = _cut(summed(same_id, "chunk"), "chunk")
    some = same_id.drop("left").join(cut, [*LEVELS, "chunk"])
    texts = some.groupBy(*LEVELS, "left", "key", "text_md5").agg(F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("each"))
    # equal rows have equal token counts; the last that is taken is number j of them
    texts = _cut(texts, "text_md5", F.col("key"), F.col("each")).withColumn("j", F.expr("(left + each - 1) div each"))
    last = stored(texts.select(*LEVELS, F.col("key").alias("last_key"), F.col("text_md5").alias("last_text"), "j", (F.col("left") - (F.col("j") - 1) * F.col("each")).alias("last_tokens")), "last")
    equal = near.withColumnsRenamed({"key": "last_key", "text_md5": "last_text"}).drop("left").join(last, [*LEVELS, "last_key", "last_text"])
    equal = equal.withColumn("task", F.shiftright("rid", 33))
    held = equal.groupBy(*LEVELS, F.col("j").alias("left"), "task").agg(F.count(F.lit(1)).alias("s"))
    inside = equal.join(_cut(held, "task"), [*LEVELS, "task"])
    number = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("rid"))  # equal rows of one partition of the input
    return inside.withColumn("number", number).where("number = left").select(*LEVELS, "last_key", "last_text", F.col("rid").alias("last_rid"), "last_tokens")


def _chosen(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows that the plan takes, with copies, taken_tokens and part, the tokens of the partial epoch. The plan has a row a leaf; Spark broadcasts it if small."""
    both = rows.where("n_tokens > 0").join(plan, LEVELS).withColumn("key", _order(seed, F.col("whole")))
    own, last = F.struct("key", "text_md5", "rid"), F.struct("last_key", "last_text", "last_rid")
    part = F.when(F.col("last_rid").isNull(), F.lit(0)).when(own < last, F.col("n_tokens")).when(own == last, F.col("last_tokens")).otherwise(F.lit(0))
    both = both.withColumn("part", part.cast("long"))
    return both.withColumns({"copies": (F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("long"), "taken_tokens": (F.col("whole") * F.col("n_tokens") + F.col("part")).cast("long")}).where("copies > 0")


def mix_sources(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float = 0.6, epochs: int = 2, seed: int = 13, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies, taken_tokens of every document in the mixture.

    Tokens are words. weights gives whole numbers by level and name, 1 where none is given, 0 to leave a
    branch out; share is the budget as a part of all tokens; no leaf is read more than `epochs` times. A null
    language or source counts as `(none)`; a null text, like one without words, is never taken; a null id is an
    id of its own. Rows that repeat an id are ordered by text, rows that repeat both are told apart, so the
    budget is met to the token. A document at the cut counts its first taken_tokens words. An empty table
    gives no rows; columns other than doc_id, text, lang and source are not read.
    """
    rows = stored(keyed(docs.select("doc_id", "text", "lang", "source"), domain).select(F.col("row.doc_id").cast("long").alias("doc_id"), *LEVELS, "n_tokens", "id", "text_md5", "rid"), "rows")
    plan = mixing_plan(rows, weights, share, epochs, seed)
    return _chosen(rows, plan, seed).select("doc_id", *LEVELS, "n_tokens", "copies", "taken_tokens")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float = 0.6, epochs: int = 2, seed: int = 13, domain: Column | None = None) -> DataFrame:
    """The rows of docs in the mixture, with all their columns, once for each epoch that takes them; see mix_sources().

    The row at a leaf's cut stands in its partial epoch with its first words only; a column n_chars follows.
    """
    rows = stored(keyed(docs, domain), "rows")
    plan = mixing_plan(rows.drop("row"), weights, share, epochs, seed)
    taken = _chosen(rows, plan, seed).select("row", "n_tokens", "copies", "part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    short = (F.col("copy") == F.col("copies")) & (F.col("part") > 0) & (F.col("part") < F.col("n_tokens"))
    text = F.when(short, first_words(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text"))
    kept = {"text": text, "n_chars": F.when(short, F.length(text)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return taken.select(*(kept.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes))
