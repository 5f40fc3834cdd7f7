"""The queries of this package, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chosen_path, components, cross_split, leaks, mixing, packing, residue, splitting
from .features import classes


def _split_tables(spark: SparkSession, d: str):
    return (
        table(spark, d, "corpus", "doc_id", "source", "text"),
        table(spark, d, "role_assignment"),
        table(spark, d, "manifest", "role", "offsets"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlaps(*_split_tables(spark, d)).select("doc_id_a", "doc_id_b")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.report(*_split_tables(spark, d))


def _fragments(spark: SparkSession, d: str):
    return table(spark, d, "fragments", "doc_id", "parent_doc_id", "fragment_index", "tokens", "token_offset_in_parent"), table(spark, d, "vocab")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut(*_fragments(spark, d)).select("parent_doc_id", "token_offset_in_parent", "token_end_in_parent").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(*_fragments(spark, d))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The documents' raw texts in pieces of at most 512 characters, sharing about 64 with the piece before: (doc_id, piece, start, end, boundary)."""
    return splitting.text_pieces(table(spark, d, "documents", "doc_id", "text")).drop("text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.near_duplicates(classes(table(spark, d, "corpus", "doc_id", "text"))).select("doc_id_a", "doc_id_b")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return chosen_path.link_counts(classes(table(spark, d, "corpus", "doc_id", "text")))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, group_id): groups of documents linked by similar sets, those with two documents or more; group_id is the smallest doc_id."""
    c = classes(table(spark, d, "corpus", "doc_id", "text"))
    links = chosen_path.similar_sets(c.sets).select("a", "b").union(c.sets.select(F.col("set_key").alias("a"), F.col("set_key").alias("b")))
    of = c.members.join(components.components(links).withColumnRenamed("id", "set_key"), "set_key")
    head = of.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.countDistinct("doc_id").alias("k")).where("k > 1")
    return of.join(head, "component").select("doc_id", "group_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.repackable(table(spark, d, "packed", "lane", "group_index", "seq_id", "attention_block_ids")).select("lane", "group_index")


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.sequences(table(spark, d, "doc_tokens"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = leaks.matches(table(spark, d, "eval_items", "item_id", "text"), table(spark, d, "documents", "doc_id", "text"))
    return m.where("verbatim").select("item_id", "doc_id").distinct()


def p5_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "eval_items", "item_id", "text"), table(spark, d, "documents", "doc_id", "text"))


def _mix(spark: SparkSession, d: str):
    return table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shortfalls(*_mix(spark, d)).select("source")


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mix(spark, d))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p7_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents", "doc_id", "text"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
