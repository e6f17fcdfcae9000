"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands what it reads back to the
next one. All stages but the last return the columns of ``documents``.

1. ``quality``: documents that the classifier of the labelled rows rejects (score below 0.3) go.
2. ``near_duplicates``: of each component of documents whose five-word shingles are similar to 0.8 or more, the smallest doc_id stays.
   Of rows that repeat doc_id and text one stays; rows that repeat a doc_id with other texts are one document: they stay or go together,
   and stage 3 takes from each of them what any of them repeats.
3. ``repeated_passages``: bytes of 100-byte strings that start earlier in the corpus go from the texts (and what is
   left of a character that was cut). A document of which nothing is left goes, too.
4. ``mixing``: a document appears as often as the mix of the sources takes it, not at all or up to three times.
5. ``token_ids``: ids of the byte-level vocabulary, and what they decode to, as digests.

Nulls: a null text counts as empty in all stages and stays null up to the last; rows with a null doc_id pass through stages 2 and
3 unchanged; an empty table stays empty; very long texts are worked on whole, one at a time per task; ties go to the smaller doc_id.
Columns that ``documents`` has besides its own are dropped by stages 1 to 4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, minhash, mixing, quality, suffix, textops
from quire.session import materialize, table_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILAR = 80
PASSAGE = 100


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = docs.select(*COLUMNS)
    trees = quality.fit(docs, spark.read.parquet(table_path(sf_dir, "labels")))
    return quality.classify(docs, trees, quality.THRESHOLD).where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of near duplicates, once per doc_id and text."""
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs, percent=SIMILAR, size=5)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # only doc_ids that come more than once go through a comparison of texts; mostly there are none
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(
        kept.join(again, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    )


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if k is None else k.decode("utf-8", "ignore") for k in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that the suffix arrays find earlier in the corpus."""
    docs = docs.select(*COLUMNS, F.col("text").isNull().alias("_none"))
    out = suffix.remove_repeats(docs, width=PASSAGE).where("n_bytes = 0 or n_removed < n_bytes")
    kept = out.select("row", F.when(~F.col("row._none"), F.col("kept")).alias("kept"))
    kind = kept.schema["row"].dataType.simpleString()
    text = kept.mapInArrow(textops.tidy(_whole_characters), f"row {kind}, text string")
    return text.select(
        "row.doc_id", "text", "row.lang", "row.source", F.coalesce(F.length("text").cast("long"), F.col("row.n_chars")).alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = docs.select(*COLUMNS)
    copies = mixing.pareto_mix(docs).select(F.col("doc_id").alias("_doc"), "copies").where("copies > 0")
    # rows that repeat a doc_id have equal copies unless their sizes differ; each row takes the smallest, so none is multiplied
    copies = copies.groupBy("_doc").agg(F.min("copies").cast("int").alias("copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]
#: the classifier and the token ids have no SQL; tests run the stages against brute force instead
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
