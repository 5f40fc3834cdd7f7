"""Queries over number formats, codecs and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations as N
from ..functions import numbers as B
from ..operators import series as S
from ..session import table
from .registry import query


def _posit(x: str, rest: str) -> str:
    """CTEs up to coded (rest, x, bits, back): the posit<16,1> of numbers x >= 1 by arithmetic, a carry of the fraction raising the scale."""
    cut = lambda p: f"13 - ({p} // 2 + 1)"
    return f"""v AS (SELECT {rest}, {x}::DOUBLE AS x, floor(log2({x}))::BIGINT AS p0 FROM {{table}} WHERE {x} >= 1),
f AS (SELECT *, floor((x / pow(2, p0) - 1) * pow(2, {cut('p0')}) + 0.5)::BIGINT AS f0 FROM v),
w AS (SELECT *, p0 + (f0 >= pow(2, {cut('p0')}))::BIGINT AS p, CASE WHEN f0 >= pow(2, {cut('p0')}) THEN 0 ELSE f0 END AS fr FROM f),
coded AS (SELECT {rest}, x, ((((1::BIGINT << (p // 2 + 2)) - 2) << (13 - p // 2)) + ((p % 2) << (12 - p // 2)) + fr)::INTEGER AS bits, (1 + fr / pow(2, {cut('p')})) * pow(2, p) AS back FROM w)"""


@query("WITH " + _posit("p_retailprice", "p_partkey").format(table="part") + " SELECT p_partkey, bits, back FROM coded")
def posit16_roundtrip(spark, d):
    x = table(spark, d, "part", "p_partkey", "p_retailprice").where("p_retailprice >= 1")
    return x.select("p_partkey", B.posit16("p_retailprice").alias("bits"), B.unposit16(B.posit16("p_retailprice")).alias("back"))


_STATS = (("mean", "avg({})"), ("median", "quantile_cont({}, 0.5)"), ("p99", "quantile_cont({}, 0.99)"), ("most", "max({})"))


@query(
    "WITH " + _posit("l_extendedprice", "l_orderkey").format(table="lineitem") + """, b AS (SELECT *, x::FLOAT::DOUBLE AS y FROM coded), e AS (SELECT abs(back / x - 1) AS posit, abs(round_even(y / pow(2, floor(log2(y))) * 128, 0) / 128 * pow(2, floor(log2(y))) / x - 1) AS bf16 FROM b),
s AS (SELECT """ + ", ".join(f"round({f.format(c)}, 9) AS {c}_{n}" for n, f in _STATS for c in ("posit", "bf16")) + """, count(*) FILTER (WHERE posit < bf16) AS posit_wins, count(*) FILTER (WHERE bf16 < posit) AS bf16_wins FROM e)
SELECT *, """ + ", ".join(f"CASE WHEN posit_{n} < bf16_{n} THEN 'posit' WHEN bf16_{n} < posit_{n} THEN 'bf16' ELSE 'tie' END AS {n}_winner" for n, _ in _STATS) + " FROM s"
)
def format_errors(spark, d):
    """Relative errors of two number formats: mean, median, 99th percentile and greatest, which is better by each, and which how often. The order statistics are exact."""
    x = table(spark, d, "lineitem", "l_extendedprice").where("l_extendedprice >= 1")
    p, b = B.unposit16(B.posit16("l_extendedprice")), B.bfloat16("l_extendedprice")
    e = x.select(F.abs(p / F.col("l_extendedprice") - 1).alias("posit"), F.abs(b / F.col("l_extendedprice") - 1).alias("bf16"))
    each = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("x")) for c in ("posit", "bf16")])).alias("e"), F.col("posit") < F.col("bf16"), F.col("bf16") < F.col("posit")).toDF("e", "pw", "bw").select("e.*", "pw", "bw")
    q = S.exact_quantiles(each.select(F.col("f").alias("run"), F.col("x").alias("value")), (0.5, 0.99))
    g = each.groupBy("f").agg(F.avg("x").alias("mean"), F.max("x").alias("most"), F.count_if("pw").alias("pw"), F.count_if("bw").alias("bw")).join(q, F.col("f") == F.col("run"))
    g = g.select("f", "pw", "bw", F.round("mean", 9).alias("mean"), F.round(F.col("q")[0], 9).alias("median"), F.round(F.col("q")[1], 9).alias("p99"), F.round("most", 9).alias("most"))
    pick = lambda c, f: F.max(F.when(F.col("f") == f, F.col(c))).alias(f"{f}_{c}")
    out = g.agg(*[pick(c, f) for c, _ in _STATS for f in ("posit", "bf16")], F.max("pw").alias("posit_wins"), F.max("bw").alias("bf16_wins"))
    return out.select("*", *[F.when(F.col(f"posit_{c}") < F.col(f"bf16_{c}"), "posit").when(F.col(f"bf16_{c}") < F.col(f"posit_{c}"), "bf16").otherwise("tie").alias(f"{c}_winner") for c, _ in _STATS])


@query("SELECT c_custkey, c_name AS name FROM customer WHERE c_name <> ''")
def byte_embedding_roundtrip(spark, d):
    """Names to vectors and back, whole; a name longer than the codec's length is several tokens."""
    length = B.byte_embedding().length
    x = table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", F.encode("c_name", "utf-8").alias("b")).where("length(b) > 0")
    at = F.sequence(F.lit(0), F.floor((F.length("b") - 1) / length).cast("int"))
    tokens = x.select("c_custkey", F.posexplode(F.transform(at, lambda k: F.substring("b", k * length + 1, F.lit(length)))).alias("k", "b"))
    back = tokens.select("c_custkey", "k", F.hex(B.unembed_bytes(B.embed_bytes("b"))).alias("h"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda p: p["h"])
    return back.groupBy("c_custkey").agg(F.decode(F.unhex(F.array_join(parts, "")), "utf-8").alias("name"))


@query("SELECT o_orderkey, CASE WHEN length(s) > 12 THEN left(s, 11) || '…' ELSE s END AS short, replace(replace('<' || s || '>&', '&', '&amp;'), '<', '&lt;') AS esc FROM (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS s FROM orders)")
def text_display(spark, d):
    s = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus")
    o = table(spark, d, "orders", "o_orderkey", s.alias("s"))
    return o.select("o_orderkey", N.truncated(F.col("s"), 12).alias("short"), F.replace(N.escaped(F.concat(F.lit("<"), "s", F.lit(">&"))), F.lit("&gt;"), F.lit(">")).alias("esc"))


@query("SELECT doc_id, round(year(d) + date_diff('day', make_date(year(d), 1, 1), d) / date_diff('day', make_date(year(d), 1, 1), make_date(year(d) + 1, 1, 1))::DOUBLE, 6) AS y FROM (SELECT DISTINCT doc_id, collected_at::DATE AS d FROM documents)")
def fractional_years(spark, d):
    c = table(spark, d, "documents", "doc_id", F.to_date("collected_at").alias("day")).distinct()
    return c.select("doc_id", F.round(N.fractional_year(F.col("day")), 6).alias("y"))


@query("""WITH x AS (SELECT event_id, (epoch(TIMESTAMP '2026-01-01') - floor(epoch(ts)))::BIGINT // 60 AS m, ts FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM x""")
def relative_times(spark, d):
    e = table(spark, d, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", N.relative_time(F.col("ts"), F.lit("2026-01-01").cast("timestamp")).alias("shown"))


def comments(spark, d):
    """A comment on each document that has text: up to 30 characters from its fourth on (from its start, where it is shorter), with their surroundings."""
    t = table(spark, d, "documents", "doc_id", "text").where("length(text) > 0").dropDuplicates(["doc_id"])
    a, n = F.floor(F.length("text") / 4).cast("int"), F.length("text")
    c = t.withColumn("a", a).withColumn("e", F.least(F.col("a") + 30, n)).withColumn("c", N.captured(F.col("text"), F.col("a"), F.col("e")))
    return t, c.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path"), F.col("a").alias("from"), F.col("e").alias("to"), "c.*", F.lit(False).alias("orphaned"))


@query("""SELECT doc_id AS id, (length(text) // 4 + 5)::INTEGER AS "from", (least(length(text) // 4 + 30, length(text)) + 5)::INTEGER AS "to", false AS orphaned FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) > 0)""")
def reanchored(spark, d):
    """Comments after five characters went in at the front of their texts."""
    t, c = comments(spark, d)
    new = t.select(F.col("doc_id").alias("path"), F.concat(F.lit("@@@@@"), "text").alias("text"))
    return N.reanchor(c, new).select("id", "from", "to", "orphaned")


@query("""SELECT event_id, (CASE WHEN event_id % 7 >= 3 THEN 1 ELSE 0 END)::INTEGER AS messages FROM events""")
def thread_edits(spark, d):
    """A thread of one message gets a reply, an edit, and in some the first message deleted; an emptied thread goes."""
    e = table(spark, d, "events", "event_id")
    one = F.array(F.struct(F.lit("m1").alias("id"), F.lit("a").alias("author"), F.lit("first").alias("text"), F.lit(False).alias("edited")))
    t = e.withColumn("thread", one).withColumn("thread", N.edited(N.replied("thread", "m2", "b", "second"), "m2", "changed"))
    gone = F.when(F.col("event_id") % 7 >= 3, N.without_message("thread", "m1")).otherwise(N.without_message(N.without_message("thread", "m1"), "m2"))
    return t.withColumn("thread", gone).select("event_id", F.size("thread").alias("messages"))
