"""Sources mixed to target shares by entropy balancing.

Each distinct text of a source gets a rate, its expected number of copies in the mix. Among all rates
that meet the targets, the ones nearest to 1 in relative entropy are exponential tilts of the text's size,
rate = exp(lambda x size / mean size), cut off at the source's cap; lambda is the source's dual variable,
found by Newton steps on the convex dual. Each step is one aggregation over a table of (source, size)
counts, which stands for all texts exactly, as texts of a source with equal sizes have equal rates; it
looks at about TRIALS values of every open dual at once, the Newton point among them, so few steps are
taken. A bracket around each dual shrinks with every step, so the steps end by themselves.
Rates are then rounded to copies in cells of bounded size, by a hash, so the mix is a function of its input.

A source falls short where its dual has no maximum: at the greatest dual variable that changes anything
every text stands at the cap, the slope is zero, and tokens are still missing. Its rates are the cap.

Source names are trimmed and lower-cased; rows with a null source, a null text or a source without a
target are left out; an empty text has size 0 and changes nothing. Equal texts of a source are one text.
Of a source named by several targets the greatest share, and the cap beside it, counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MOST_TARGETS = 10_000
TRIALS = 24
CELL = 512
TOLERANCE = 1e-9
#: The exponent from which exp() is taken as 0 or as over any cap.
FAR = 700.0


def _clean(name: str):
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def targets(mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row a source; rows with a null in any of them are left out."""
    own = mix_targets.select(_clean("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    own = own.where("source is not null and target_share is not null and max_repeats is not null")
    return own.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")


def texts(documents: DataFrame, mix_targets: DataFrame, size=None) -> DataFrame:
    """(source, text_key, doc_id, size): each distinct text of a source with a target, with its smallest id. size: a Column over text; UTF-8 bytes (the tokens of the byte tokenizer) unless given."""
    size = F.octet_length("text") if size is None else size
    rows = documents.select(_clean("source").alias("source"), F.sha2("text", 256).alias("text_key"), "doc_id", size.cast("bigint").alias("size")).where("text_key is not null")
    rows = rows.join(mix_targets.select(_clean("source").alias("source")).where("source is not null").distinct(), "source")
    return rows.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))


def sized(rows: DataFrame) -> DataFrame:
    """(source, size, texts) of texts(), as a small written table for the Newton steps."""
    return written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("texts")), "sizes")


def _rate(dual, size, mean, cap):
    x = F.greatest(F.least(dual * size / mean, F.lit(FAR)), F.lit(-FAR))
    return F.when(x <= -FAR, F.lit(0.0)).otherwise(F.least(F.exp(x), cap))


def _rows(mix_targets: DataFrame, most: int) -> list:
    rows = targets(mix_targets).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources with a target; raise most_targets")
    return rows


def _trials(s: dict) -> list[float]:
    """The values of the dual to look at: an even division of the bracket, and values that close in on the Newton point."""
    low, high, near = s["low"], s["high"], TRIALS // 3
    even = [low + (high - low) * k / (TRIALS - 2 * near + 1) for k in range(1, TRIALS - 2 * near + 1)]
    closing = [s["dual"] + side * s["width"] * 8.0**-k for k in range(near) for side in (-1, 1)] + [s["dual"]]
    return sorted({x for x in (*even, *closing, *s["ends"]) if low <= x <= high})


def _narrowed(s: dict, seen: list) -> None:
    """The state of a source after a step that saw rows (trial, tokens, slope, below)."""
    gap = lambda r: s["target"] - r.tokens
    if any(r.below == 0 and gap(r) > 0 for r in seen):  # every text at the cap and the slope zero: the dual has no maximum
        s.update(short=True, done=True, dual=s["high"])
        return
    s["low"] = max([s["low"], *(r.trial for r in seen if gap(r) > 0)])
    s["high"] = min([s["high"], *(r.trial for r in seen if gap(r) <= 0)])
    best = min(seen, key=lambda r: abs(gap(r)))
    if abs(gap(best)) <= TOLERANCE * max(1.0, s["target"]) or s["high"] - s["low"] <= 1e-15 * max(abs(s["low"]), abs(s["high"])):
        s.update(done=True, dual=best.trial)
        return
    newton = best.trial + gap(best) / best.slope if best.slope > 0 else math.inf
    s["dual"] = newton if s["low"] < newton < s["high"] else (s["low"] + s["high"]) / 2
    s["width"], s["ends"] = min(s["high"] - s["low"], 2 * abs(s["dual"] - best.trial)), ()


def balance(sizes: DataFrame, mix_targets: DataFrame, most_targets: int = MOST_TARGETS) -> list[dict]:
    """One dict a source of mix_targets: source, target_share, max_repeats, texts, size, target, dual, mean, short.

    sizes: (source, size, texts), how many distinct texts of a source have a size. The state of the steps
    is a few numbers a target; a plan of more than most_targets sources is refused.
    """
    spark, out = sizes.sparkSession, {}
    w = F.col("size") * F.col("texts")
    own = {r.source: r for r in sizes.groupBy("source").agg(F.sum("texts").alias("texts"), F.sum(w).alias("size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()}
    total = sum(r.size for r in own.values())
    for t in _rows(mix_targets, most_targets):
        n, size, least = (own[t.source].texts, own[t.source].size, own[t.source].least) if t.source in own else (0, 0, None)
        target, mean, open_ = t.target_share * total, size / n if size else 1.0, bool(size) and t.max_repeats >= 1
        s = {"source": t.source, "target_share": t.target_share, "max_repeats": t.max_repeats, "texts": n, "size": size, "target": target, "mean": mean, "dual": 0.0, "width": 1.0, "low": 0.0, "high": 0.0, "done": not open_, "short": not open_ and target > 0}
        if open_:  # at low the mix is no larger than the target, at high every text is at the cap
            s["low"] = (-FAR if target <= 0 else min(math.log(target / size), 0.0) - 1e-6) * mean / least
            s["high"] = (math.log(t.max_repeats) + 1e-6) * mean / least
        s["ends"] = (s["low"], s["high"])
        out[t.source] = s
    while todo := [s for s in out.values() if not s["done"]]:
        points = [(s["source"], s["mean"], float(s["max_repeats"]), x) for s in todo for x in _trials(s)]
        now = spark.createDataFrame(points, "source string, mean double, cap double, trial double")
        e = _rate(F.col("trial"), F.col("size"), F.col("mean"), F.col("cap"))
        free = (e < F.col("cap")) & (F.col("size") > 0)
        seen = (
            sizes.join(F.broadcast(now), "source")  # at most some 24 rows a target
            .groupBy("source", "trial")
            .agg(F.sum(w * e).alias("tokens"), F.sum(F.when(free, w * e * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"), F.sum(F.when(free, w).otherwise(0)).alias("below"))
            .collect()
        )
        for s in todo:
            _narrowed(s, [r for r in seen if r.source == s["source"]])
    return list(out.values())


_SOLVED = "source string, target_share double, max_repeats int, texts bigint, size bigint, target double, dual double, mean double, short boolean"


def solution(documents: DataFrame, mix_targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, duals): the texts of the sources with a target, and a row for each such source with what balance() found."""
    rows = texts(documents, mix_targets)
    names = [f.split()[0] for f in _SOLVED.split(", ")]
    solved = [tuple(s[k] for k in names) for s in balance(sized(rows), mix_targets)]
    return rows, rows.sparkSession.createDataFrame(solved, _SOLVED)


def shortfalls(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """The duals of the sources that fall short even with each text at its cap."""
    return solution(documents, mix_targets)[1].where("short")


def _drawn(rows: DataFrame, duals: DataFrame) -> DataFrame:
    """(source, doc_id, size, rate, copies): rates rounded so that the copies add up to the rates.

    The texts of a source are dealt by a hash to cells of about CELL; within a cell, in order of size,
    the running sum of the rates is rounded, from a start keyed by the cell. A text's copies are its
    rate rounded up or down, and a cell's tokens are off by about one text.
    """
    few = duals.select("source", "max_repeats", "dual", "mean", "short", F.greatest(F.lit(1), F.ceil(F.col("texts") / F.lit(CELL))).alias("cells"))
    cap = F.greatest(F.col("max_repeats"), F.lit(0)).cast("double")
    rate = F.when(F.col("short"), cap).otherwise(_rate(F.col("dual"), F.col("size"), F.col("mean"), cap))
    own = rows.join(few, "source").withColumn("rate", rate).withColumn("cell", F.pmod(F.xxhash64("text_key"), F.col("cells")))
    w = Window.partitionBy("source", "cell").orderBy("size", "text_key")
    start = F.pmod(F.xxhash64("source", "cell"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    own = own.withColumn("upto", F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0)) + start).withColumn("before", F.coalesce(F.lag("upto").over(w), start))
    return own.select("source", "doc_id", "size", "rate", F.least(F.floor("upto") - F.floor("before"), F.col("max_repeats")).cast("int").alias("copies"))


def mix(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, doc_id, size, rate, copies): the texts in the mix, none over its cap; texts without a copy are left out."""
    return _drawn(*solution(documents, mix_targets)).where("copies > 0")


def shares(documents: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_copies, short) of every source with a target. actual_share is null where the mix is empty."""
    rows, duals = solution(documents, mix_targets)
    got = _drawn(rows, duals).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    got = duals.select("source", "target_share", "short").join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    got = got.withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row a target
    return got.select("source", "target_share", (F.col("tokens") / F.nullif("all", F.lit(0))).alias("actual_share"), "tokens", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "short")
