"""Queries over draws, lanes and candidate selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..operators import mixture as M
from ..operators import selection as S
from ..session import table
from .packing import packed
from .registry import query


def draws(spark, d):
    """The packed sequences as draws: 16 branches, drawn in the order of a hash. (branch, draw, seq_id, lane, effective, total)"""
    h = F.sha2("seq_id", 256)
    one = packed(spark, d, "lane", "loss_mask").select(F.substring(h, 1, 1).alias("branch"), h.alias("h"), "seq_id", "lane", F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("effective"), F.size("loss_mask").cast("bigint").alias("total"))
    return one.withColumn("draw", F.row_number().over(Window.partitionBy("branch").orderBy("h"))).drop("h")


_DRAWS = """p AS (SELECT seq_id, any_value(lane) AS lane, any_value(list_sum(loss_mask))::BIGINT AS effective FROM packed GROUP BY seq_id),
draws AS (SELECT substr(sha256(seq_id), 1, 1) AS branch, row_number() OVER (PARTITION BY substr(sha256(seq_id), 1, 1) ORDER BY sha256(seq_id)) AS draw, seq_id, lane, effective FROM p)"""
_W = config.STAGES[-1].weights
_BEFORE = ", ".join(f"coalesce(sum(CASE WHEN lane = '{k}' THEN effective ELSE 0 END) OVER w, 0) AS \"c_{k}\"" for k in _W)
_TOTAL = " + ".join(f'"c_{k}"' for k in _W)
_LACK = {k: f'({v / sum(_W.values())!r}::DOUBLE * ({_TOTAL}) - "c_{k}")' for k, v in _W.items()}


@query(f"""WITH {_DRAWS}, r AS (SELECT *, {_BEFORE} FROM draws WINDOW w AS (PARTITION BY branch ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT branch, draw::INTEGER AS draw, lane, effective, greatest({', '.join(_LACK.values())}) AS best, {', '.join(f'{e} AS "d_{k}"' for k, e in _LACK.items())} FROM r)
SELECT branch, draw, lane, effective, round(best, 6) AS deficit, CASE {' '.join(f'WHEN "d_{k}" = best THEN {chr(39)}{k}{chr(39)}' for k in sorted(_W))} END AS expected,
CASE {' '.join(f'WHEN "d_{k}" = best THEN {chr(39)}{k}{chr(39)}' for k in sorted(_W))} END = lane AS as_planned FROM x""")
def deficit_audit(spark, d):
    return M.deficits(draws(spark, d).select("branch", "draw", "lane", "effective"), _W)


@query(f"""WITH {_DRAWS}, plan AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _W.items())}) t(lane, weight)),
g AS (SELECT branch, lane, weight / (SELECT sum(weight) FROM plan) AS planned FROM (SELECT DISTINCT branch FROM draws), plan),
s AS (SELECT branch, lane, sum(effective) AS e FROM draws GROUP BY ALL), t AS (SELECT branch, sum(e) AS t FROM s JOIN plan USING (lane) GROUP BY branch)
SELECT branch, lane, round(planned, 9) AS planned, round(coalesce(e::DOUBLE / nullif(t, 0), 0), 9) AS actual FROM g LEFT JOIN s USING (branch, lane) LEFT JOIN t USING (branch)""")
def planned_vs_actual(spark, d):
    return M.planned_vs_actual(draws(spark, d), _W).select("branch", "lane", F.round("planned", 9).alias("planned"), F.round("actual", 9).alias("actual"))


@query(f"""WITH {_DRAWS}, x AS (SELECT branch, draw, lane, avg(CASE WHEN lane LIKE 'verified-%' THEN 1.0::DOUBLE ELSE 0 END) OVER w AS share, count(*) OVER w AS seen FROM draws WINDOW w AS (PARTITION BY branch ORDER BY draw ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT branch, draw::INTEGER AS draw, lane, round(share, 6) AS share FROM x WHERE seen >= 4 AND share < 0.3::DOUBLE""")
def floor_window_breach(spark, d):
    return M.floor_breaches(draws(spark, d).select("branch", "draw", "lane"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
k AS (SELECT pos, substr(sha256('1337|opus-sketch|0|hash|' || pos), 1, 16) AS k FROM range(64) t(pos)),
u AS (SELECT pos, ('0x' || substr(sha256(unhex(k || '0000000000000000')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u0, ('0x' || substr(sha256(unhex(k || '0000000000000001')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u1 FROM k)
SELECT vec_id, (floor(u0 * 64)::INTEGER % 64)::INTEGER AS bucket, round(sum(x::DOUBLE * CASE WHEN u1 < 0.5 THEN 1 ELSE -1 END), 5) AS value FROM e JOIN u USING (pos) WHERE x <> 0 GROUP BY ALL""")
def countsketch_project(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.countsketch(v, 64).select(F.col("id").alias("vec_id"), "bucket", F.round("value", 5).alias("value"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    return S.rows_blockwise(v.where("id % 100 = 0"), v, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT 'lane' || (label % 3) AS lane, vec_id AS id, (row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1) AS idx, embedding[1]::DOUBLE AS score FROM embeddings),
k AS (SELECT *, substr(sha256('1337|root|0|boltzmann|' || id), 1, 16) AS k FROM s),
u AS (SELECT *, greatest(least(('0x' || substr(sha256(unhex(k || lpad(printf('%x', idx), 16, '0'))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS u FROM k)
SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY pow(u, 1.0::DOUBLE / exp(score / 0.5::DOUBLE)) DESC, idx)::INTEGER AS rank FROM u""")
def weighted_sample_order(spark, d):
    lane = F.concat(F.lit("lane"), (F.col("label") % 3).cast("string"))
    s = table(spark, d, "embeddings").select(lane.alias("lane"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("score"))
    s = s.withColumn("idx", F.row_number().over(Window.partitionBy("lane").orderBy("id")) - 1)
    return S.weighted_order(s).select("lane", "id", "rank")


def _candidates(spark, d):
    """The packed sequences as candidates: a score in (-1, 1) from a keyed draw, earlier deferrals from another."""
    from ..functions import hashing as H

    own = packed(spark, d, "lane", "loss_mask", "token_provenance")
    k = H.key_hex(config.SEED, "root", 0, "score", F.col("seq_id"))
    bad = F.size(F.filter(F.arrays_zip("loss_mask", "token_provenance"), lambda x: (x.loss_mask == 1) & x.token_provenance.isNull()))
    return own.select(
        F.col("seq_id").alias("id"), "lane", F.lit("TRAIN").alias("role"), (H.uniform_column(k, F.lit(0)) * 2 - 1).alias("score"),
        F.floor(H.uniform_column(k, F.lit(1)) * 4).cast("int").alias("defers"), (F.col("lane") == "verified-pdf").alias("floor_breach"), bad.alias("padding_faults"),
    )


_CAND = """p AS (SELECT seq_id AS id, any_value(lane) AS lane FROM packed GROUP BY seq_id), k AS (SELECT *, substr(sha256('1337|root|0|score|' || id), 1, 16) AS k FROM p),
c AS (SELECT id, lane, ('0x' || substr(sha256(unhex(k || '0000000000000000')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE * 2 - 1 AS score,
  floor(('0x' || substr(sha256(unhex(k || '0000000000000001')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE * 4)::INTEGER AS defers FROM k),
r AS (SELECT *, CASE WHEN score >= 0.15::DOUBLE THEN 'ACCEPT' WHEN score <= -0.15::DOUBLE THEN 'REJECT' ELSE 'DEFER' END AS rule FROM c),
v AS (SELECT *, defers + (rule = 'DEFER')::INTEGER AS defer_count, CASE WHEN rule = 'DEFER' AND defers + 1 > 3 THEN 'REJECT' ELSE rule END AS late FROM r),
o AS (SELECT *, late = 'REJECT' AND lane = 'verified-pdf' AS floor_override FROM v),
decided AS (SELECT id, lane, defer_count, floor_override, CASE WHEN floor_override THEN 'ACCEPT' ELSE late END AS classification FROM o)"""


@query(f"WITH {_CAND} SELECT id, classification, defer_count, floor_override FROM decided")
def candidate_decisions(spark, d):
    return S.decide(_candidates(spark, d)).select("id", "classification", "defer_count", "floor_override")


@query(f"WITH {_CAND} SELECT lane, classification, count(*) AS decisions, count(*) FILTER (WHERE floor_override) AS overrides FROM decided GROUP BY ALL")
def decision_counts(spark, d):
    c = _candidates(spark, d)
    return S.decide(c).join(c.select("id", "lane"), "id").groupBy("lane", "classification").agg(F.count(F.lit(1)).alias("decisions"), F.count_if("floor_override").alias("overrides"))


@query(f"""WITH {_CAND}, q AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) AS r, coalesce(sum((classification = 'DEFER')::INTEGER) OVER (PARTITION BY lane ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM decided)
SELECT lane, id, classification FROM q WHERE r <= 24 AND stopped = 0""")
def scoring_frontier(spark, d):
    c = _candidates(spark, d)
    decided = S.decide(c).join(c.select("id", "lane"), "id").withColumn("queue_index", F.col("id"))
    return S.frontier(decided, config.POOL).select("lane", "id", "classification")
