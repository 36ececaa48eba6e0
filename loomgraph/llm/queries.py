"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import canonical, docpairs, history, leakage, origin, syntax, tokenize, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.found(_table(spark, sf_dir, "files"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.report(_table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found(_table(spark, sf_dir, "facts"), _table(spark, sf_dir, "predicates"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched_report(_table(spark, sf_dir, "facts"), _table(spark, sf_dir, "predicates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(_table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.found(_table(spark, sf_dir, "files"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(_table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.found(_table(spark, sf_dir, "files"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(_table(spark, sf_dir, "files"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "doc_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "doc_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "doc_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_unmatched, p3_found, p4_found, p4_rates, p5_found, p5_pairs, p6_ids, p7_found, p7_spans, p7_items, p8_found, p8_scores, p8_rates)
}
ORACLE_SQL: dict[str, str] = {}
