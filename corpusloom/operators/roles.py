"""Lanes, roles and the gate before training.

Lane: the first rule whose tier matches and whose type matches or is open; else null. Role: a bucket of the
id's hash against cumulative bounds; quarantined documents get QUARANTINE. Nulls give a null lane and role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def lane(tier="tier", kind="type") -> Column:
    clean = lambda c: F.lower(F.trim(c))
    rule = None
    for name, t, k in config.LANES:
        fits = (clean(tier) == t) & ((clean(kind) == k) if k else F.lit(True))
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
    return rule


def bucket(doc_id="doc_id", buckets: int = 1000) -> Column:
    return F.conv(F.substring(F.sha2(doc_id, 256), 1, 8), 16, 10).cast("bigint") % buckets


def role(doc_id="doc_id") -> Column:
    rule = None
    for name, upper in config.ROLE_BOUNDS:
        fits = bucket(doc_id) < upper
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
    return rule


def assign(docs: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """docs with role; ids in quarantined (doc_id) get QUARANTINE."""
    if quarantined is None:
        return docs.withColumn("role", role())
    flag = quarantined.select("doc_id").distinct().withColumn("_q", F.lit(True))
    return docs.join(flag, "doc_id", "left").withColumn("role", F.when(F.col("_q"), "QUARANTINE").otherwise(role())).drop("_q")


def partition_faults(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, fault): ids without a role, and rows with an unknown one. Empty if the table is a partition."""
    missing = ids.select("doc_id").distinct().join(table.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("fault"))
    unknown = table.where(~F.coalesce(F.col("role").isin(*config.ROLES), F.lit(False))).select("doc_id", F.lit("unknown role").alias("fault"))
    return missing.unionByName(unknown)


PURPOSES = {"training": ("TRAIN",), "validation": ("VALIDATION",), "proxy": ("PROXY",)}


def admitted(df: DataFrame, purpose: str) -> DataFrame:
    """df, failing at run time on the first row whose role is not one for the purpose; an unknown or null role fails too."""
    fits = F.coalesce(F.col("role").isin(*PURPOSES[purpose]), F.lit(False))
    message = F.concat(F.lit(f"not admitted for {purpose}: "), F.coalesce(F.col("role"), F.lit("no role")), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return df.withColumn("role", F.when(fits, F.col("role")).otherwise(F.raise_error(message)))


def rejected(df: DataFrame, purpose: str) -> DataFrame:
    """The rows the gate would stop, with the reason."""
    known = F.coalesce(F.col("role").isin(*config.ROLES), F.lit(False))
    return df.where(~F.coalesce(F.col("role").isin(*PURPOSES[purpose]), F.lit(False))).withColumn("reason", F.when(known, F.concat(F.lit("role "), F.col("role"))).otherwise("unknown role"))
