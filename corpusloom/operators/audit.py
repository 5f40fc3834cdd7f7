"""Findings about tables, and the evidence made of them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "name string, passed boolean, faults bigint, detail string"


def finding(name: str, faults: DataFrame, detail: str) -> DataFrame:
    """One row: a check that passes where faults has no row."""
    n = faults.agg(F.count(F.lit(1)).alias("faults"))
    return n.select(F.lit(name).alias("name"), (F.col("faults") == 0).alias("passed"), "faults", F.lit(detail).alias("detail"))


def evidence(findings: DataFrame) -> dict:
    """The findings as a bundle; a row a check comes to the driver."""
    rows = [r.asDict() for r in findings.orderBy("name").collect()]
    return {"findings": rows, "all_passed": all(r["passed"] for r in rows)}


def markdown(bundle: dict) -> str:
    lines = ["# Findings", "", "| Check | Result | Faults | Detail |", "|-|-|-|-|"]
    lines += [f"| {f['name']} | {'PASS' if f['passed'] else 'FAIL'} | {f['faults']} | {f['detail']} |" for f in bundle["findings"]]
    return "\n".join([*lines, "", f"Overall: {'PASS' if bundle['all_passed'] else 'FAIL'}", ""])


def run_log(bundle: dict) -> list[str]:
    """A line a finding, with a tag that a reader of logs can look for."""
    return [f"[{'PASS' if f['passed'] else 'FAIL'}] {f['name']}: {f['detail']} ({f['faults']} faults)" for f in bundle["findings"]]


def write_evidence(bundle: dict, folder: str) -> None:
    """findings.json, findings.md and run.log in a folder, each whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    for name, text in (("findings.json", json.dumps(bundle, ensure_ascii=False, indent=2, sort_keys=True)), ("findings.md", markdown(bundle)), ("run.log", "\n".join(run_log(bundle)) + "\n")):
        tmp = os.path.join(folder, f".{name}.{os.getpid()}")
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, os.path.join(folder, name))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(name, passed) out of run logs."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").rlike(r"^\[(PASS|FAIL)\] ")).select(F.regexp_extract("value", r"^\[\w+\] (\w+):", 1).alias("name"), F.col("value").startswith("[PASS]").alias("passed"))
