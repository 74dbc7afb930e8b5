"""From raw documents to packed training sequences.

``run`` applies STAGES in order to ``documents``; each stage reads what the one before wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm import common, language, line_spread, near_copies, packing, quality
from keepsake.llm.common import remainder, table
from keepsake.llm.queries import tokenizer


def beside(docs: DataFrame, made: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` as ``change`` returns them; those named like what it makes stand aside meanwhile."""
    p = common.prefix(docs)
    aside = {c: p + c for c in docs.columns if c.lower() in made}
    changed = change(docs.withColumnsRenamed(aside))
    return changed.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known and not ambiguous.

    Documents without a letter go (null and empty texts among them); repeated rows are judged alike. Columns stay as they are.
    """
    common.prepared(spark)
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    known = (F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")
    return beside(docs, ["lang_pred", "score", "ambiguous"], lambda d: language.identify(d, model).filter(known))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier counts as good.

    Null texts count as empty and are scored like any other; repeated rows are judged alike; without labels all have one score.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    good = F.col("predicted") == 1
    return beside(docs, ["score", "predicted", "top_passage"], lambda d: quality.score(d, model).filter(good))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that many sources share; every document stays. n_chars, where there is one, follows the text."""
    common.prepared(spark)

    def cleaned(d: DataFrame) -> DataFrame:
        out = line_spread.without_boilerplate(d)
        if "n_chars" not in d.columns:
            return out
        left = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", left.cast(d.schema["n_chars"].dataType))

    return beside(docs, ["n_lines", "n_removed"], cleaned)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of five-word shingles) stays: that of the smallest id.

    Null and empty texts, and rows without id, are in no group. Of rows with the same id (or none) and text one stays, whatever
    its other columns: the first by a hash of these.
    """
    common.prepared(spark)
    p = common.prefix(docs)
    gone = near_copies.near_copies(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(f"{p}gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(f"{p}gone"), "left_anti")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keyed = left.withColumns({f"{p}t": F.xxhash64("text"), f"{p}u": F.xxhash64(F.lit(9), "text"), f"{p}order": F.xxhash64(*hashed)})
    first = Window.partitionBy("doc_id", f"{p}t", f"{p}u").orderBy(f"{p}order")
    once = keyed.withColumn(f"{p}copy", F.row_number().over(first)).filter(F.col(f"{p}copy") == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with sequence and place.

    A null or empty text is the end id alone; repeated rows are packed each; ids may be null; no rows give none.
    """
    common.prepared(spark)
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
