"""From documents to training shards: five stages, each the whole of what the stage before kept.

All stages but the last give the columns of documents, in their order; further columns of the input are dropped at
the first stage. Texts are read whole, however long. An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearplane.llm import decontamination, jaccard_join, source_mixing, token_output, toxicity
from nearplane.llm._common import read_table, stored
from nearplane.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIPELINE_SHARE = 0.8  # of the tokens that reach the mixture


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, trained on the labelled documents of the table (a bounded sample); documents predicted toxic go.

    Rows with a null, empty or letterless text stay; rows that repeat a text are decided alike; without a toxic label
    all stay.
    """
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 on five-word shingles at 0.8; the smallest doc_id of each group stays.

    Decided by row: where an id stands for several texts, each is judged in its own group. Equal rows of the smallest
    id all stay, a null id counts as the smallest, and rows without words are groups of their own.
    """
    return jaccard_join.one_per_group(docs.select(*COLUMNS), k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; documents with a benchmark passage go. Rows with a null or empty text stay; null or empty items match nothing."""
    return decontamination.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; a document stands once for each epoch that takes it, at a leaf's cut with its first words only.

    The words that are left are the budget, to the word. Rows with a null text, or one without words, are never taken;
    a null language or source is a branch of its own; rows that are equal are taken one by one.
    """
    return source_mixing.mixture(docs.select(*COLUMNS), MIX_WEIGHTS, PIPELINE_SHARE, MIX_EPOCHS, MIX_SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9; a row for each document in its files, in ascending order of doc_id, null first, repeated ids side by side."""
    return token_output.token_output(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_per_group),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", write_tokens),
]

#: Similarity links, string kernels, edit matching and tokenizers are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
