"""A corpus pipeline of five stages: toxicity, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``; rows of null doc_id pass through the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import packing, secrets, simhash, substring, toxicity
from orbitframe.llm.common import maybe_in, prepare, row_key, staged

TOXIC_FROM = 0.5
NEAR_SIMILARITY = 0.8
PASSAGE_WORDS = 50
SEQUENCE = 2048


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity grammar rejects. Every row is judged by itself, without a join."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = toxicity.fit_toxicity(docs, labels)
    score = toxicity.score_column(*fitted)
    return docs.filter(F.col("doc_id").isNull() | (score("text") < TOXIC_FROM))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, of the smallest doc_id: five-word shingles, similarity 0.8. Of rows
    that repeat an id, others stay if they aren't near duplicates; of rows of one id and text one stays."""
    groups = simhash.near_duplicates(docs, shingle=5, similarity=NEAR_SIMILARITY)
    # Rows that go, not rows that stay: most stay, so the table that texts are joined to is the small one.
    counts = staged(groups.filter("doc_id IS NOT NULL").groupBy("doc_id", F.col("key").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("doc_id = component_id AND key = component_key")).alias("first")).filter("n > 1 OR NOT first"), "copies")
    # A document travels as one struct, so that its columns may have any names. Texts that the tables of keys rule out aren't shuffled; of the
    # others, those that stay and those of which one of several rows stays are looked for apart, as the latter are few or none.
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.struct(*docs.columns).alias("doc"))
    several = counts.filter("n > 1 AND first")
    listed, repeated = maybe_in(counts, "row"), maybe_in(several, "row")
    alone = rows.filter(~listed("row")).select("doc.*")
    stay = rows.filter(listed("row")).join(counts, ["doc_id", "row"], "left_anti").select("doc.*")
    again = rows.filter(repeated("row")).join(several.select("doc_id", "row"), ["doc_id", "row"]).groupBy("doc_id", "row").agg(F.min("doc").alias("doc"))
    return alone.unionByName(stay).unionByName(again.select("doc.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of fifty words or more that a document of a smaller id has; drop documents of which nothing is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    cut = substring.substring_dedup(docs.select("doc_id", "text", carried.alias("doc")), window=PASSAGE_WORDS, layout=True, carry=("doc",)).filter("n_removed = 0 OR n_removed < n_words")
    columns = {c: F.col(f"carry.doc.c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col("carry.doc.no_text"), F.col("kept"))}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length("kept").cast("long"))
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document goes."""
    clean = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean.select(*docs.columns)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: one row per piece."""
    return packing.packed_documents(docs, packing.tokenizer_path("byte_bpe_50k.json"), length=SEQUENCE)


STAGES = [
    ("toxicity", keep_clean),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scans", hide_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs


#: SQL can express neither the grammar's regression nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None
