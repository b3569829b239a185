"""A corpus pipeline of five stages over the documents table: quality rules, near-deduplication, benchmark
decontamination, mixing to source weights, and token-id output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
writes each stage's result and reads it again for the next one. No stage looks at rows that an earlier one removed.

Cases: columns besides doc_id, text and source pass through all stages but the last as they are, whatever their names;
n_chars, where there is one, follows the text. Documents with null or empty texts fail the quality rules. Rows with a null
doc_id are linked with nothing and all stay; of several rows with one doc_id that pass the rules, near-deduplication keeps
one. A null source is a source of its own. Repeated rows in the mix are repeated documents in the token files. An empty
table gives no rows at any stage; a very long text is one row's work at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm.common import Scratch, hidden, read_table, scratch_path
from claimforge.llm.decontaminate import drop_contaminated
from claimforge.llm.mixing import repeat_documents
from claimforge.llm.near_dedup import keep_one_of_each
from claimforge.llm.quality_rules import apply_quality_rules
from claimforge.llm.token_output import read_token_files, write_token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars follows the text."""
    inner, own = hidden(docs, "text", "n_chars")
    judged = apply_quality_rules(inner).where("kept").withColumn("text", F.col("cleaned_text"))
    if "n_chars" in docs.columns:
        judged = judged.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return judged.select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 over five-word shingles, the one of the least doc_id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's target takes it."""
    return repeat_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    return read_token_files(spark, write_token_files(docs, scratch_path(spark, "token-files")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Links of near-duplicates form components, and token ids come from a tokenizer: no SQL. The tests hold the stages
#: against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
