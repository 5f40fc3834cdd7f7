"""Pieces of SQL for the text functions, shared by the queries that need them."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, SUFFIXES

_cases = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN length(w) >= {len(s) + 2} THEN left(w, length(w) - {len(s)}) ELSE w END" for s in sorted(SUFFIXES, key=len, reverse=True))
STEM = f"CASE {_cases} ELSE w END"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The words of nfc_normalize(text); Python's white space is wider than \s.
WORDS = r"""regexp_extract_all(nfc_normalize(text), '[^\s\v\p{Z}\x{85}\x{1c}-\x{1f}.,!?;:"''()\[\]{}।॥]+')"""
DOCS = "docs AS (SELECT doc_id, any_value(text) AS text FROM corpus WHERE text IS NOT NULL GROUP BY doc_id)"
SHINGLED = f"""stems AS (SELECT doc_id, text, list_transform(list_filter({WORDS}, lambda w: w NOT IN ({STOP})), lambda w: {STEM}) AS ws FROM docs),
shingled AS (SELECT doc_id, text, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM stems)"""
PAIRS = """sets AS (SELECT doc_id, len(sh) AS n, sh FROM shingled WHERE len(sh) > 0),
parts AS (SELECT doc_id, n, unnest(sh) AS s FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM parts a JOIN parts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
alike AS (SELECT a, b, c::DOUBLE / (na + nb - c) AS jaccard FROM pairs WHERE c::DOUBLE / (na + nb - c) >= 0.8::DOUBLE)"""
CORPUS = "c AS (SELECT doc_id, min(lower(trim(tier))) AS tier, min(lower(trim(type))) AS type, min(lower(trim(source))) AS source, any_value(text) AS text FROM corpus GROUP BY doc_id)"
LANE = "CASE WHEN tier = 'verified' AND type = 'web' THEN 'verified-web' WHEN tier = 'verified' AND type = 'speech' THEN 'verified-speech' WHEN tier = 'verified' AND type = 'pdf' THEN 'verified-pdf' WHEN tier = 'unverified' THEN 'unverified' WHEN tier = 'synthetic' THEN 'synthetic' END"
BUCKET = "(('0x' || substr(sha256(doc_id), 1, 8))::BIGINT % 1000)"
ROLE = f"CASE WHEN {BUCKET} < 700 THEN 'TRAIN' WHEN {BUCKET} < 800 THEN 'VALIDATION' WHEN {BUCKET} < 900 THEN 'EVAL' ELSE 'PROXY' END"
