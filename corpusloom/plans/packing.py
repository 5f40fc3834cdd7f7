"""Queries over tokens and packed sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import packing as P
from ..operators import roles
from ..session import table
from .registry import query


def train_tokens(spark, d):
    t = table(spark, d, "doc_tokens").where("role = 'TRAIN'").select("doc_id", "lane", "tokens")
    return t.dropDuplicates(["doc_id"])


def packed(spark, d, *columns):
    return table(spark, d, "packed", "seq_id", *columns).dropDuplicates(["seq_id"])


_TRAIN = "t AS (SELECT doc_id, any_value(lane) AS lane, any_value(tokens) AS tokens FROM doc_tokens WHERE role = 'TRAIN' GROUP BY doc_id)"
_PARTS = "CASE WHEN len(tokens) <= 128 OR lane IN ('verified-web', 'verified-speech') THEN 1 ELSE ceil(len(tokens) / 128.0)::BIGINT END"
_FRAGS = f"""{_TRAIN}, e AS (SELECT doc_id, lane, tokens, {_PARTS} AS parts, unnest(range({_PARTS})) AS i FROM t),
f AS (SELECT CASE WHEN parts > 1 THEN doc_id || '::frag' || i ELSE doc_id END AS doc_id, doc_id AS parent_doc_id, lane, i::INTEGER AS fragment_index, len(tokens[i * 128 + 1:i * 128 + 128])::INTEGER AS n FROM e)"""
_SIZE = "CASE lane WHEN 'verified-web' THEN 16 WHEN 'verified-speech' THEN 18 WHEN 'verified-pdf' THEN 12 ELSE 14 END"


@query(f"WITH {_FRAGS} SELECT doc_id, parent_doc_id, lane, fragment_index, n FROM f")
def pack_fragments(spark, d):
    return P.fragments(train_tokens(spark, d)).select("doc_id", "parent_doc_id", "lane", "fragment_index", F.size("tokens").alias("n"))


@query(f"WITH {_FRAGS} SELECT lane, doc_id, ((row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1) // {_SIZE})::INTEGER AS group_index FROM f")
def pack_groups(spark, d):
    return P.grouped(P.fragments(train_tokens(spark, d))).select("lane", "doc_id", "group_index")


def _exact(items: str, needed: str = "true") -> str:
    """CTEs up to lim (g, m, total, ffd) and binned (g, i, bin) of items (g, i, n): the fewest bins of 128 by a table over the subsets of each group for which needed holds, one size of subsets an iteration; way has 5 bits for the bin of each item.

    A subset's value is its bins and the room taken in the open one; of equally good last items the latest counts.
    Subsets that cannot be completed within the first-fit-decreasing number are on no best way and are left out.
    """
    return f"""its AS ({items}), srt AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, i) AS r FROM its),
fit AS (SELECT DISTINCT g, 0::BIGINT AS r, []::BIGINT[] AS rooms FROM its UNION ALL
SELECT f.g, s.r, CASE WHEN len(list_filter(rooms, lambda x: x >= s.n)) = 0 THEN list_append(rooms, 128 - s.n) ELSE list_transform(rooms, lambda x, k: CASE WHEN k = list_position(list_transform(rooms, lambda y: y >= s.n), true) THEN x - s.n ELSE x END) END FROM fit f JOIN srt s ON s.g = f.g AND s.r = f.r + 1),
lim AS (SELECT g, count(*) AS m, sum(n)::BIGINT AS total, any_value(ffd) AS ffd FROM its JOIN (SELECT g, len(arg_max(rooms, r)) AS ffd FROM fit GROUP BY g) USING (g) GROUP BY g),
dp AS (SELECT g, 0::BIGINT AS mask, 128::BIGINT AS v, 0::HUGEINT AS way, 0::BIGINT AS u, m, total, ffd FROM lim WHERE {needed}
UNION ALL SELECT g, nm, min(k) // 64, arg_min(way + ((k // 16384 - 1)::HUGEINT << (5 * i)), k), any_value(nu), any_value(m), any_value(total), any_value(ffd) FROM (SELECT *, (CASE WHEN v % 256 + n <= 128 THEN v + n ELSE (v // 256 + 1) * 256 + n END) * 64 + 63 - i AS k
  FROM (SELECT dp.*, its.i, its.n, dp.mask | (1::BIGINT << its.i) AS nm, u + its.n AS nu FROM dp JOIN its ON its.g = dp.g WHERE (dp.mask >> its.i) & 1 = 0))
  WHERE k // 16384 + greatest(total - nu - (128 - k // 64 % 256) + 127, 0) // 128 <= ffd GROUP BY g, nm),
binned AS (SELECT g, i, ((way >> (5 * i)) % 32)::BIGINT AS bin FROM (SELECT g, way, unnest(range(m)) AS i FROM dp WHERE mask = (1::BIGINT << m) - 1))"""


def _packed_sql(docs: str, size: str, cap: str, parts: str) -> str:
    """CTEs up to out (seq_id, lane, group_index, bin_index, doc_ids_present, input_ids, loss_mask) of docs (doc_id, lane, tokens)."""
    items = "SELECT lane || ':' || group_index AS g, (row_number() OVER (PARTITION BY lane, group_index ORDER BY doc_id) - 1)::INTEGER AS i, len(t) AS n FROM grp"
    return f"""WITH RECURSIVE {docs}, e AS (SELECT doc_id, lane, tokens, {parts} AS parts, unnest(range({parts})) AS i FROM t),
f AS (SELECT CASE WHEN parts > 1 THEN doc_id || '::frag' || i ELSE doc_id END AS doc_id, lane, tokens[i * 128 + 1:i * 128 + 128] AS t FROM e),
grp AS (SELECT *, ((row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1) // {size})::INTEGER AS group_index FROM f), {_exact(items)},
placed AS (SELECT grp.*, bin, (row_number() OVER (PARTITION BY lane, group_index, bin ORDER BY doc_id) - 1) // {cap} AS slice FROM (SELECT *, lane || ':' || group_index AS g, row_number() OVER (PARTITION BY lane, group_index ORDER BY doc_id) - 1 AS i FROM grp) grp JOIN binned USING (g, i)),
bins AS (SELECT lane, group_index, bin, slice, list(doc_id ORDER BY doc_id) AS doc_ids_present, flatten(list(t ORDER BY doc_id)) AS ids, flatten(list(list_concat([0], list_transform(range(len(t) - 1), lambda x: 1)) ORDER BY doc_id)) AS mask FROM placed GROUP BY ALL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY lane, group_index ORDER BY bin, slice) - 1)::INTEGER AS bin_index, row_number() OVER (PARTITION BY lane ORDER BY group_index, bin, slice) - 1 AS number FROM bins),
out AS (SELECT lane || ':g' || group_index || ':b' || bin_index || ':' || number AS seq_id, lane, group_index, bin_index, doc_ids_present, list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)) AS input_ids, list_concat(mask, list_transform(range(128 - len(mask)), lambda x: 0)) AS loss_mask FROM numbered)"""


_CAP = "CASE lane WHEN 'verified-web' THEN 8 WHEN 'verified-speech' THEN 12 WHEN 'verified-pdf' THEN 4 ELSE 6 END"


@query(_packed_sql(_TRAIN, _SIZE, _CAP, _PARTS) + " SELECT seq_id, lane, group_index, bin_index, doc_ids_present, input_ids, loss_mask FROM out")
def pack_lanes(spark, d):
    """The packing of all TRAIN documents, let in by the gate: fewest bins in each group."""
    t = table(spark, d, "doc_tokens", "doc_id", "role", "lane", "tokens").where("role = 'TRAIN'").dropDuplicates(["doc_id"])
    return P.pack(roles.admitted(t, "training").where(F.col("role") == "TRAIN").select("doc_id", "lane", "tokens")).select("seq_id", "lane", "group_index", "bin_index", "doc_ids_present", "input_ids", "loss_mask")


@query(
    _packed_sql("t AS (SELECT doc_id, any_value(role) AS lane, any_value(tokens) AS tokens FROM doc_tokens WHERE role IN ('PROXY', 'VALIDATION') GROUP BY doc_id)", "14", "1000000", "CASE WHEN len(tokens) <= 128 THEN 1 ELSE ceil(len(tokens) / 128.0)::BIGINT END")
    + " SELECT seq_id, doc_ids_present FROM out"
)
def pack_role_agnostic(spark, d):
    """PROXY and VALIDATION documents, each role packed as one lane, without a document cap."""
    t = table(spark, d, "doc_tokens").where(F.col("role").isin("PROXY", "VALIDATION")).select("doc_id", F.col("role").alias("lane"), "tokens").dropDuplicates(["doc_id"])
    return P.pack(t, policies={}, cap=False).select("seq_id", "doc_ids_present")


@query("""WITH p AS (SELECT seq_id, any_value(lane) AS lane, any_value(input_ids) AS i, any_value(attention_block_ids) AS b, any_value(loss_mask) AS m FROM packed GROUP BY seq_id),
s AS (SELECT lane, count(*) AS sequences, sum(len(i))::BIGINT AS total, sum(len(list_filter(b, lambda x: x >= 0)))::BIGINT AS used, sum(list_sum(m))::BIGINT AS loss_bearing FROM p GROUP BY lane)
SELECT *, coalesce(used::DOUBLE / nullif(total, 0), 0) AS used_ratio, coalesce(loss_bearing::DOUBLE / nullif(total, 0), 0) AS loss_ratio FROM s""")
def lane_utilization(spark, d):
    return P.utilisation(packed(spark, d, "lane", "input_ids", "attention_block_ids", "loss_mask"))


@query("""WITH p AS (SELECT seq_id, any_value(attention_block_ids) AS b FROM packed GROUP BY seq_id),
e AS (SELECT seq_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM p), c AS (SELECT seq_id, x, count(*) AS k FROM e WHERE x >= 0 GROUP BY ALL)
SELECT seq_id, sum(k * (k + 1) // 2)::BIGINT AS visible FROM c GROUP BY seq_id""")
def attention_visible(spark, d):
    """How many (i, j) pairs the block-diagonal causal mask of each sequence lets through."""
    own = packed(spark, d, "attention_block_ids").select("seq_id", P.attention_mask(F.col("attention_block_ids")).alias("m"))
    count = F.aggregate("m", F.lit(0).cast("bigint"), lambda a, row: a + F.aggregate(row, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return own.select("seq_id", count.alias("visible")).where("visible > 0")


@query("""WITH p AS (SELECT seq_id, any_value(loss_mask) AS m, any_value(attention_block_ids) AS b FROM packed GROUP BY seq_id),
e AS (SELECT seq_id, unnest(m) AS m, unnest(b) AS b FROM p) SELECT seq_id, count(*) AS faults FROM e WHERE m = 1 AND b = -1 GROUP BY seq_id""")
def loss_on_padding(spark, d):
    """Sequences that bear loss where there is no document: none may."""
    own = packed(spark, d, "loss_mask", "token_provenance")
    bad = F.size(F.filter(F.arrays_zip("loss_mask", "token_provenance"), lambda x: (x.loss_mask == 1) & x.token_provenance.isNull())).cast("bigint")
    return own.select("seq_id", bad.alias("faults")).where("faults > 0")


@query("""WITH p AS (SELECT seq_id, any_value(position_ids) AS p, any_value(attention_block_ids) AS b FROM packed GROUP BY seq_id),
e AS (SELECT seq_id, generate_subscripts(p, 1) AS i, unnest(p) AS p, unnest(b) AS b FROM p),
w AS (SELECT seq_id, p, row_number() OVER (PARTITION BY seq_id, b ORDER BY i) - 1 AS want FROM e WHERE b >= 0)
SELECT seq_id, count(*) AS tokens, count(*) FILTER (WHERE p <> want) AS wrong FROM w GROUP BY seq_id""")
def position_reset_audit(spark, d):
    """Whether positions start anew with each document of a sequence."""
    from pyspark.sql import Window

    e = packed(spark, d, "position_ids", "attention_block_ids").select("seq_id", F.posexplode(F.arrays_zip("position_ids", "attention_block_ids")).alias("i", "x")).where("x.attention_block_ids >= 0")
    want = F.row_number().over(Window.partitionBy("seq_id", "x.attention_block_ids").orderBy("i")) - 1
    return e.withColumn("want", want).groupBy("seq_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("x.position_ids") != F.col("want")).alias("wrong"))


@query("""SELECT role, lane, count(*) AS docs, sum(n)::BIGINT AS tokens, max(n)::INTEGER AS longest FROM (SELECT doc_id, any_value(role) AS role, any_value(lane) AS lane, any_value(len(tokens)) AS n FROM doc_tokens GROUP BY doc_id) GROUP BY ALL""")
def token_counts(spark, d):
    t = table(spark, d, "doc_tokens", "doc_id", "role", "lane", F.size("tokens").alias("n")).groupBy("doc_id").agg(F.max("role").alias("role"), F.max("lane").alias("lane"), F.max("n").alias("n"))
    return t.groupBy("role", "lane").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


_GROUP_ITEMS = """SELECT g, (row_number() OVER (PARTITION BY g ORDER BY seq_id, b) - 1)::INTEGER AS i, n FROM (SELECT lane || ':' || group_index AS g, seq_id, b, count(*) AS n FROM (SELECT seq_id, any_value(lane) AS lane, any_value(group_index) AS group_index, unnest(any_value(attention_block_ids)) AS b FROM packed GROUP BY seq_id) WHERE b >= 0 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_exact(_GROUP_ITEMS, "ffd > ceil(total / 128.0)")}, f AS (SELECT g, any_value(ffd) AS ffd, coalesce(max(bin) + 1, any_value(ffd)) AS exact FROM lim LEFT JOIN binned USING (g) GROUP BY g), p AS (SELECT DISTINCT lane, group_index, seq_id FROM packed)
SELECT lane, group_index, count(*) AS sequences, any_value(ffd)::INTEGER AS ffd, any_value(exact)::INTEGER AS exact, any_value(ffd) <= 11 / 9.0::DOUBLE * any_value(exact) + 6 / 9.0::DOUBLE + 1e-9 AS within_bound FROM p JOIN f ON f.g = lane || ':' || group_index GROUP BY ALL""")
def packing_quality(spark, d):
    """Each group of packed: its sequences, the first-fit-decreasing and least possible numbers for its items, and whether the one is within its bound of the other."""
    blocks = F.filter("attention_block_ids", lambda b: b >= 0)
    own = packed(spark, d, "lane", "group_index", "attention_block_ids").select("lane", "group_index", F.transform(F.array_distinct(blocks), lambda b: F.size(F.filter("attention_block_ids", lambda x: x == b))).alias("n"))
    groups = own.groupBy("lane", "group_index").agg(F.count(F.lit(1)).alias("sequences"), F.flatten(F.collect_list("n")).alias("n"))

    @F.udf("struct<ffd:int,exact:int,within:boolean>", useArrow=True)
    def both(n):
        n = [int(x) for x in n]
        ffd = max(P.first_fit_decreasing(n, config.SEQ_LEN), default=-1) + 1
        exact = max(P.exact_bins(n, config.SEQ_LEN), default=-1) + 1 if len(n) <= config.EXACT_GROUP else None
        return {"ffd": ffd, "exact": exact, "within": None if exact is None else P.within_bound(ffd, exact)}

    return groups.withColumn("b", both("n")).select("lane", "group_index", "sequences", "b.ffd", "b.exact", F.col("b.within").alias("within_bound"))
