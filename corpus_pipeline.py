"""The corpus pipeline: five training-data operators, one after another, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet below the shared checkpoint folder and reads it back as the next
one's ``docs``, so a lost executor never costs more than the stage at hand.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.decontaminate import decontaminated
from sluice.llm.jaccard_join import near_duplicates
from sluice.llm.line_dedup import line_dedup as dedup_lines
from sluice.llm.packing import pack
from sluice.llm.quality_rules import quality_rules as judge
from sluice.session import scratch_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns as one, so that none clashes with a column an operator adds."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(True).alias("none")])).alias("_others"))


def _unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_others").getField(c).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules do not reject."""
    return _unpacked(judge(_packed(docs)).filter("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs are deleted; a document that held nothing else goes, ``n_chars`` follows the text."""
    out = dedup_lines(_packed(docs)).filter("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        followed = F.col("_others").withField("n_chars", F.length("text").cast("long"))
        out = out.withColumn("_others", F.when(F.col("n_removed") > 0, followed).otherwise(F.col("_others")))
    return _unpacked(out, docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id; rows without an id stay."""
    scratch = scratch_root(spark, "classes")
    near_duplicates(docs).write.parquet(scratch)
    classes = spark.read.parquet(scratch).filter("doc_id IS NOT NULL")
    marks = (classes.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("_gone"), (F.count(F.lit(1)) > 1).alias("_repeated"))
             .filter("_gone OR _repeated"))
    # both readers of this join share one exchange of the texts; rows without an id never meet in one task
    judged = _packed(docs).filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").filter("_gone IS NULL OR NOT _gone")
    # rows repeated whole or with one id and text are copies, too: one of them stays
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    one = judged.filter("_repeated").withColumn("_nth", first).filter("_nth = 1")
    parts = [_packed(docs).filter("doc_id IS NULL"), judged.filter("_repeated IS NULL"), one]
    return reduce(DataFrame.unionByName, [_unpacked(p, docs.columns) for p in parts])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and the sequence that each is packed into."""
    import public_tokenizers as P
    return pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None  # expectation-maximisation, latent retrieval and tokenizers are beyond SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = _table(spark, sf_dir, "documents"), scratch_root(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
