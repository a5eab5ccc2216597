"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import align, chat, common, decontaminate, language, lines, phrases, pieces, repeats, simhash, toxicity, urls, vectors, warc
from emberline.sources import folders


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(common.table(spark, sf_dir, "documents"))


def op2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(common.table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(common.table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(common.table(spark, sf_dir, "documents"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_tricky(common.table(spark, sf_dir, "conversations"))))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(common.table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = folders.workspace(spark, "archive")
    warc.write(common.table(spark, sf_dir, "pages"), archive)
    return warc.read(spark, archive)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(common.table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_overlaps": op2_overlaps,
    "op3_language": op3_language,
    "op4_url_rules": op4_url_rules,
    "op5_pieces": op5_pieces,
    "op6_near_copies": op6_near_copies,
    "op7_toxicity": op7_toxicity,
    "op8_chat": op8_chat,
    "op9_vectors": op9_vectors,
    "op10_warc": op10_warc,
    "op11_lines": op11_lines,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_repeats": repeats.ORACLE,
    "op2_overlaps": decontaminate.ORACLE,
    "op4_url_rules": urls.oracle(),
    "op8_chat": chat.ORACLE,
    "op9_vectors": vectors.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_lines": lines.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
