"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import (bpe, chat_format, collocations, decontaminate, html_text, importance, license_scan, lm_corpus,
                          merkle, minhash, ngram_join, oracles, quality_rules, secret_scan)
from staylens.llm.common import hex_sha256, table


def tokenizer() -> dict:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    out, c = quality_rules.judge(docs, rules, keep=["doc_id"])
    return out.select("doc_id", *[f"{c}.{n}" for n in (*quality_rules.BASE, "base_failed", "kept", "rule")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    finds = F.transform(F.col(f"{c}.finds"), lambda f: F.concat_ws(
        ":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    return out.select("doc_id", f"{c}.n_licenses", f"{c}.licenses", f"{c}.best", f"{c}.coverage",
                      F.array_join(finds, ",").alias("finds"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_turns(rows))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", f"{c}.text", f"{c}.n_chars", f"{c}.n_lines")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.col(c)

    def count(kind: int):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter(spans, lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        hex_sha256(secret_scan.span_list(base)).alias("base_sha256"),
        secret_scan.span_list(spans).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                         keep=["doc_id"])
    v = F.col(c)
    return out.select(
        "doc_id", v["n_words"].alias("n_words"), v["n_hit"].alias("n_hit"),
        F.size(v["items"]).cast("bigint").alias("n_items"),
        hex_sha256(F.array_join(v["items"], ",")).alias("items_sha256"),
        v["contaminated"].alias("contaminated"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = lm_corpus.score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *[f"{c}.{n}" for n in ("n_words", "target_loss", "background_loss", "difference")])


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, c = bpe.round_trip(table(spark, sf_dir, "documents"), **tokenizer(), keep=["doc_id"])
    return out.select("doc_id", f"{c}.n_tokens", f"{c}.ids_sha256", f"{c}.decoded_sha256")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = [F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in fields]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(docs, fields, "doc_id", "source", also={"tampered": F.when(tampered, merkle.leaf(lowered))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return made.rows.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_license_scan, op3_chat_format, op4_html_text, op5_importance_resampling,
        op6_secret_scan, op7_decontaminate, op8_lm_score, op9_byte_bpe, op10_minhash_dedup,
        op11_merkle_manifest, op12_phrase_collocations, op13_ngram_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": oracles.OP3, "op6_secret_scan": oracles.OP6, "op7_decontaminate": oracles.OP7,
            "op11_merkle_manifest": oracles.OP11, "op12_phrase_collocations": oracles.OP12,
            "op13_ngram_join": oracles.OP13}
