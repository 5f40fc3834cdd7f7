"""Queries through the library's sources and the tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import roles, shards
from ..operators import tokenizer as TK
from ..session import scratch_path, table, written
from ..sources import formats as S
from .corpus import docs
from .registry import query
from .text_sql import CORPUS, ROLE


@query("""SELECT doc_id, lane, len(t)::INTEGER AS n, list_sum(t)::BIGINT AS total FROM (SELECT doc_id, any_value(lane) AS lane, any_value(tokens) AS t FROM doc_tokens GROUP BY doc_id)""")
def shard_write_read(spark, d):
    """All documents' tokens to binary shards of at most 64,000 tokens and back, each shard held against its hashes."""
    t = table(spark, d, "doc_tokens", "doc_id", "lane", "tokens").dropDuplicates(["doc_id"])
    out = scratch_path(spark, "shards").removeprefix("file://")
    shards.write_shards(t, out, "tokenizer").write.format("noop").mode("overwrite").save()
    back = shards.read_shards(spark, f"file://{out}")
    return back.select("doc_id", "lane", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""SELECT count(*) AS records, sum(event_id)::BIGINT AS ids, max(event_type) AS last FROM events""")
def tagged_log_roundtrip(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    back = S.logged(S.tagged(e, "RESULT_JSON "), "RESULT_JSON ", "event_id bigint, event_type string")
    return back.agg(F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("ids"), F.max("event_type").alias("last"))


@query("""SELECT event_id, event_type AS id, strftime(ts, '%Y-%m-%d') AS date FROM events""")
def js_record_extraction(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "ts")
    text = F.concat(F.lit("[ { id: '"), "event_type", F.lit("', date: \""), F.date_format("ts", "yyyy-MM-dd"), F.lit("\", pays: ['a'] } ]"))
    return e.select("event_id", F.explode(S.js_records(text, ["id", "date"])).alias("r")).select("event_id", "r.id", "r.date")


@query(r"""WITH t AS (SELECT text FROM documents UNION ALL SELECT '<a href="https://example.org/' || event_type || '">x</a>' FROM events) SELECT DISTINCT unnest(regexp_extract_all(text, 'https?://[^\s"''<>)\]]+')) AS url FROM t WHERE text IS NOT NULL""")
def url_extraction(spark, d):
    """The distinct addresses in the documents' texts, and in markup around the events."""
    t = F.concat(F.lit('<a href="https://example.org/'), "event_type", F.lit('">x</a>'))
    texts = table(spark, d, "documents", "text").union(table(spark, d, "events", t.alias("text"))).where("text is not null")
    return texts.select(F.explode(S.urls(F.col("text"))).alias("url")).distinct()


@query("""WITH c AS (SELECT doc_id, any_value(octet_length(encode(text))) AS n FROM corpus WHERE text IS NOT NULL GROUP BY doc_id), r AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS upto FROM c), k AS (SELECT * FROM r WHERE upto <= 120000000)
SELECT doc_id, CASE WHEN upto <= 0.99::DOUBLE * (SELECT max(upto) FROM k) THEN 'train' ELSE 'validation' END AS split FROM k""")
def byte_capped_split(spark, d):
    return S.byte_cap(docs(spark, d).where("text is not null").select("doc_id", "text"), 120_000_000).select("doc_id", "split")


def _tokenizer(spark, d):
    train = roles.assign(docs(spark, d).where("text is not null")).where("role = 'TRAIN'")
    return TK.train(train.select("text"))


#: The merges by a recursive query: a token is the character of its id + 256, a merge replaces the oftenest two characters, from the left.
_CHARS = "array_to_string(list_transform(range(octet_length(b)), lambda i: chr(260 + ('0x' || substr(hex(b), 2 * i + 1, 2))::INTEGER)), '')"
_BPE = f"""{CORPUS}, train AS (SELECT text, count(*) AS copies FROM c WHERE text IS NOT NULL AND {ROLE} = 'TRAIN' GROUP BY text),
spelt AS (SELECT copies, {_CHARS} AS s FROM (SELECT copies, encode(nfc_normalize(text)) AS b FROM train)),
m AS (SELECT 0 AS rank, NULL::VARCHAR AS pair, list(struct_pack(s := s, n := copies)) AS texts FROM spelt
UNION ALL
SELECT rank + 1, best.pair, list_transform(texts, lambda x: struct_pack(s := replace(x.s, best.pair, chr(516 + rank)), n := x.n)) FROM m,
LATERAL (SELECT arg_min(pair, (-k, pair)) AS pair FROM (SELECT pair, sum(n) AS k FROM (SELECT unnest(list_transform(list_zip(ch[:-2], ch[2:]), lambda z: z[1] || z[2])) AS pair, n FROM (SELECT string_split(x.s, '') AS ch, x.n AS n FROM (SELECT unnest(m.texts) AS x))) GROUP BY pair) WHERE k >= 2) best
WHERE rank < 252 AND best.pair IS NOT NULL)"""


@query(f"WITH RECURSIVE {_BPE} SELECT (rank - 1)::INTEGER AS rank, (ord(pair[1]) - 256)::INTEGER AS a, (ord(pair[2]) - 256)::INTEGER AS b, (259 + rank)::INTEGER AS new_id FROM m WHERE pair IS NOT NULL")
def bpe_merges(spark, d):
    """The merges of the byte-pair tokenizer of the TRAIN documents, over all their bytes."""
    t = _tokenizer(spark, d)
    return spark.createDataFrame([(k, a, b, TK.FIRST_MERGE + k) for k, (a, b) in enumerate(t.merges)], "rank int, a int, b int, new_id int")


@query(f"""WITH RECURSIVE {_BPE}, learnt AS (SELECT rank, pair FROM m WHERE pair IS NOT NULL),
e AS (SELECT doc_id, 0 AS r, {_CHARS} AS s FROM (SELECT doc_id, encode(nfc_normalize(text)) AS b FROM c WHERE text IS NOT NULL) UNION ALL SELECT doc_id, r + 1, replace(s, pair, chr(516 + r)) FROM e JOIN learnt ON rank = r + 1)
SELECT e.doc_id, (length(s) + 2)::INTEGER AS tokens, sha256(nfc_normalize(text)) AS back FROM e JOIN c USING (doc_id) WHERE r = (SELECT count(*) FROM learnt)""")
def bpe_roundtrip(spark, d):
    """Every text encoded and decoded: its tokens, and the hash of what comes back."""
    t = _tokenizer(spark, d)
    e = docs(spark, d).where("text is not null").select("doc_id", t.encode_column("text").alias("ids"))
    return e.select("doc_id", F.size("ids").alias("tokens"), F.sha2(t.decode_column("ids"), 256).alias("back"))


@query(f"""WITH RECURSIVE {_BPE} SELECT sha256('{{"merges":[' || string_agg('[' || (ord(pair[1]) - 256) || ',' || (ord(pair[2]) - 256) || ']', ',' ORDER BY rank) || '],"nfc":true,"pretokenize":"byte","specials":["<PAD>","<BOS>","<EOS>","<UNK>"],"tiebreak":"lexicographic_pair","train_manifest_hash":"","vocab_size":' || (260 + count(*)) || '}}') AS freeze_hash, true AS same_again FROM m WHERE pair IS NOT NULL""")
def tokenizer_freeze(spark, d):
    """The hash that freezes the tokenizer, and whether one made of its merges has it too."""
    t = _tokenizer(spark, d)
    return spark.createDataFrame([(t.freeze_hash(), TK.Tokenizer(tuple(map(tuple, t.merges))).freeze_hash() == t.freeze_hash())], "freeze_hash string, same_again boolean")


@query("""WITH t AS (SELECT DISTINCT text FROM eval_items), b AS (SELECT encode(text) AS b FROM eval_items WHERE text IS NOT NULL)
SELECT octet_length(b)::BIGINT AS bytes, count(*) AS items FROM b GROUP BY ALL""")
def byte_lengths(spark, d):
    return table(spark, d, "eval_items", "text").where("text is not null").groupBy(F.octet_length("text").cast("bigint").alias("bytes")).agg(F.count(F.lit(1)).alias("items"))


