"""From raw documents to token ids: toxicity, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read back as the
next stage's docs. All but the last return the columns of documents.

In every stage: a null text is an empty one; an empty table gives an empty table; extra columns pass through, whatever
their names, up to the last stage. Toxicity keeps rows of every repeat of a clean text. Near duplicates keep the least doc_id
of a group; rows repeated whole count as one; documents without words are no one's copies. Repeated passages cut both
sides of a repeat, the same document's included, and may leave an empty text; n_chars follows. The mix takes a null source
for the source ''. Ties between equal rows fall either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.bpe import bpe_round_trip
from eventloom.llm.common import materialize, read_table
from eventloom.llm.jaccard_join import one_of_each_group
from eventloom.llm.mixing import in_mixed_order, with_file_position
from eventloom.llm.registry import default_vocabulary
from eventloom.llm.suffix_dedup import without_repeats
from eventloom.llm.toxicity import fit_examples, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    model = fit_examples(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links of five-word shingles, at 0.75 or more, connect."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start elsewhere too are cut from the texts; n_chars follows."""
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources."""
    return in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, mix_position: the place in the mix, from the files of the stage before."""
    return bpe_round_trip(with_file_position(docs), default_vocabulary(), with_ids=True, position_col="mix_position")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Nearest-neighbour votes, components, suffix arrays, schedules and byte pairs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
