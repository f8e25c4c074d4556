"""The corpus pipeline: five operators in turn over `documents`, each stage's rows written before the next reads them.

1. toxicity: documents predicted toxic go, each row by its own text. 2. line dedup: repeated lines go from the texts, and
documents of which nothing but white space is left go whole. 3. near-dedup: of each group of near copies (similarity 0.8
or more) the smallest doc_id stays. 4. decontamination: documents holding a benchmark passage go. 5. BPE: what is left is
encoded, with the token ids.

All columns of documents stay until the last stage; n_chars is set anew where texts change. Texts that are null or empty
to begin with stay. Stages 2 to 4 tell rows by doc_id. Where doc_id is null or shared, a stage first numbers its rows, by
ascending doc_id (null last), so that such rows are told apart too, and of copies the first row stays.

Texts are shuffled once, where line dedup puts them together anew. Scores stay beside the texts, and ids of rows that go
are broadcast if there are at most BROADCAST_IDS of them; only beyond that are texts shuffled to drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from ridgeline.llm.common import written

#: 8 MB of ids.
BROADCAST_IDS = 1_000_000
ROW = "_row"


def _with_rows(docs: DataFrame) -> DataFrame:
    """docs with _row: doc_id where each row has its own, else the row's number, from a written table so that it is stable."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id IS NULL OR n > 1").limit(1).count() == 0:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns)]
    return written(docs.orderBy(*order).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose _row is not in gone(_row)."""
    gone = written(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, ROW, "left_anti").select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "_toxicity", without=()).where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _with_rows(docs)
    out = line_dedup.dedup_lines(rows.withColumnRenamed("doc_id", "_own").withColumnRenamed(ROW, "doc_id"))
    out = out.drop("doc_id").withColumnRenamed("_own", "doc_id")
    changed, left = F.col("n_dropped") > 0, F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~changed | left).withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _with_rows(docs)
    found = near_dedup.near_duplicates(_by_row(rows), percent=80)
    return _without(rows, found.where("NOT kept").select(F.col("doc_id").alias(ROW)), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _with_rows(docs)
    found = decontaminate.contamination(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.where("n_hit > 0").select(F.col("doc_id").alias(ROW)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, bpe.default_vocabulary()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str, rows: dict[str, int] | None = None) -> DataFrame:
    """The last stage's rows. rows, where given, gets how many rows each stage before it left, and how many it began with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if rows is not None:
        rows["documents"] = docs.count()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if rows is not None:
            rows[name] = docs.count()
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trees, sketches and merges can't be written in SQL; the tests hold the stages' decisions against brute force.
ORACLE_SQL = None
