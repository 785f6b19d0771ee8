"""The corpus pipeline: quality rules, near-dedup, removal of repeated passages, mixing of sources, token encoding.

Each stage takes all rows that the one before it kept.  Rows with equal doc_id and text are copies of one document and
leave the near-dedup as one; rows that share only the doc_id are documents of their own; documents without id stay, as
no group can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import mixing, quality, queries, shingles, suffixes, tokens
from tallyweave.llm.common import documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints within two bits, or by a Jaccard similarity of 0.8 on five
    words: the one with the smallest id."""
    docs = docs.select(*COLUMNS)
    same = shingles.near_duplicates(docs).where("doc_id = component_id").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    found = materialize(same.groupBy("root").agg(F.min(F.struct("doc_id", "mark", "n")).alias("least")).select("least.*"))
    many = found.where("n > 1").select("doc_id", "mark")
    marked = docs.withColumn("mark", shingles.mark())
    # A sort-merge join at every size: the ids grow with the documents, so a broadcast would end at some size.
    kept = marked.join(found.where("n = 1").select("doc_id", "mark").hint("merge"), ["doc_id", "mark"], "left_semi").select(*COLUMNS)
    if not many.isEmpty():
        kept = kept.union(marked.join(many, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]).select(*COLUMNS))
    return kept.union(docs.where("doc_id is null"))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document with a smaller id."""
    return suffixes.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole time."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix_sources(docs).where("taken > 0")
    times = mixed.groupBy("doc_id", "mark").agg(F.round(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int").alias("times"))
    times = times.where("times > 0").withColumnsRenamed({"doc_id": "id", "mark": "m"})
    marked = docs.withColumn("mark", shingles.mark())
    repeated = marked.join(times, marked["doc_id"].eqNullSafe(times["id"]) & (marked["mark"] == times["m"]))
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    encoded = tokens.encode_documents(docs, queries.tokenizer_path())
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("passage dedup", passages_stage),
    ("source mixing", mixing_stage),
    ("token encoding", tokens_stage),
]
#: The network of hashes and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
