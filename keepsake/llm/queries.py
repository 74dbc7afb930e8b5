"""Queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import (
    alignment, cleaning, common, language, line_spread, merge_replay, mixing, near_copies, order_minhash, packing, periodic, quality,
    revisits, token_files)
from keepsake.llm.common import remainder, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    scored = quality.score(docs.select("doc_id", "text"), quality.learn(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "top_passage")


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "|")
    return found.select("record_id", "response_id", F.unix_timestamp("response_at").alias("response_at"), "outcome",
                        "payload_digest", shown.alias("headers"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op5_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.withColumn("cleaned_sha256", F.sha2("cleaned_text", 256)).drop("text", "cleaned_text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(common.prepared(spark), "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op7_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return merge_replay.digests(merge_replay.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
                          F.sha2("text", 256).alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string"))
    found = periodic.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), also={"_number": number},
                               reading=lambda batch, count: periodic.repeating(batch, count, "_number"))
    return periodic.digests(found)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).measures


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality, op2_near_copies, op3_revisits, op4_order_minhash, op5_cleaning, op6_token_files, op7_merge_replay,
        op8_language, op9_line_spread, op10_packing, op11_periodic_runs, op12_alignment,
        op13_mixture)}


def oracle_sql() -> dict[str, str]:
    return {"op3_revisits": revisits.SQL, "op5_cleaning": cleaning.SQL, "op9_line_spread": line_spread.SQL,
            "op13_mixture": mixing.SQL}
