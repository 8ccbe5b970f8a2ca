"""The queries of this subpackage and the SQL that says the same, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelake.llm import chat, collocations, decontam, linededup, quality, repeats, simhash, urlfilter, vectorcodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.simhash import component_digest

    return component_digest(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.linededup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.pieces import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.pii import span_digest

    return span_digest(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.warc import archive_digest

    return archive_digest(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.urlfilter import url_digest

    return url_digest(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.chat import conversation_digest

    return conversation_digest(table(spark, sf_dir, "conversations"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.repeats import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.tokencount import count_digest

    return count_digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelake.llm.vectorcodes import code_digest

    return code_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_pieces": op2_pieces,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_repeats": op8_repeats,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_url_filter": urlfilter.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op7_chat": chat.ORACLE_SQL,
    "op8_repeats": repeats.ORACLE_SQL,
    "op9_decontaminate": decontam.ORACLE_SQL,
    "op10_simhash": simhash.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_vector_codes": vectorcodes.ORACLE_SQL,
}
