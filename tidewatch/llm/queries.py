"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, fingerprints, langid, merkle, mixing, neardup, partenum, repair, simple8b, suffixes, topk, urls, warc
from tidewatch.llm.common import scratch, table

URL_RULES: list[urls.Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=0.8)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), ("kept_sha256", "text")).drop("tag")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.decode(warc.reassemble(warc.read(spark, folder)), with_payload=False)


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "simple8b")
    simple8b.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return simple8b.with_starts(simple8b.read(spark, folder, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"), words=5, similarity=0.8)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_near_duplicates, op3_bpe, op4_mixing, op5_url_filter, op6_repeated_strings, op7_language_id, op8_topk, op9_warc, op10_simple8b, op11_jaccard_join, op12_merkle, op13_repair)
}

ORACLE_SQL = {
    "op2_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, max(a.n) + max(b.n) - count(*) AS u FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * u UNION SELECT b, a FROM pairs WHERE 100 * i >= 80 * u),
        reach AS (SELECT doc_id AS d, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM sets JOIN reach ON d = doc_id GROUP BY doc_id, s""",
    "op11_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, max(a.n) + max(b.n) - count(*) AS u FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * u UNION SELECT b, a FROM pairs WHERE 100 * i >= 80 * u),
        reach AS (SELECT doc_id AS d, doc_id AS c FROM sets UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, min(c) AS component_id FROM sets JOIN reach ON d = doc_id GROUP BY doc_id, s""",
    "op12_merkle": r"""
        WITH RECURSIVE fields AS (
            SELECT *, row_number() OVER () AS r,
                   coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id, '-') || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
                   || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars, '-') AS head,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM documents),
        bits AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                     lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE z END))) AS c
                 FROM (SELECT DISTINCT doc_id FROM documents)),
        leaves AS (
            SELECT r, f.doc_id, lang, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
                   CASE WHEN xor(c, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(small))::VARCHAR || ':' || small, '-')) END AS tampered
            FROM fields f LEFT JOIN bits USING (doc_id)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
        tree AS (
            SELECT 0 AS h, lang, rank, n, leaf AS digest FROM ranked
            UNION ALL
            SELECT h + 1, lang, rank // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY rank)) FROM tree WHERE n > 1 GROUP BY h, lang, rank // 8),
        tops AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
        crown AS (
            SELECT 0 AS h, rank, n, digest FROM tops
            UNION ALL
            SELECT h + 1, rank // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY rank)) FROM crown WHERE n > 1 GROUP BY h, rank // 8),
        parts AS (
            SELECT h, lang, rank, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY h, lang, rank // 8 ORDER BY rank)),
        crown_parts AS (
            SELECT h, rank, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY h, rank // 8 ORDER BY rank)),
        way AS (
            SELECT r, 0 AS h, lang, rank, coalesce(tampered, leaf) AS digest, '' AS proof FROM ranked
            UNION ALL
            SELECT r, way.h + 1, way.lang, way.rank // 8, sha256(l || digest || t), proof || l || t
            FROM way JOIN parts p ON p.h = way.h AND p.lang IS NOT DISTINCT FROM way.lang AND p.rank = way.rank),
        below AS (SELECT r, lang, max_by(digest, h) AS digest, max_by(proof, h) AS proof FROM way GROUP BY r, lang),
        over_way AS (
            SELECT r, 0 AS h, tops.rank, below.digest, proof, tops.digest AS subroot FROM below JOIN tops ON tops.lang IS NOT DISTINCT FROM below.lang
            UNION ALL
            SELECT r, o.h + 1, o.rank // 8, sha256(l || digest || t), proof || l || t, subroot FROM over_way o JOIN crown_parts p ON p.h = o.h AND p.rank = o.rank),
        done AS (SELECT r, any_value(subroot) AS subroot, max_by(digest, h) AS folded_root, max_by(proof, h) AS proof FROM over_way GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM done JOIN ranked USING (r), (SELECT digest AS root FROM crown WHERE n = 1)""",
    "op13_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
        kinds AS (SELECT name, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
                     lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE z END)))) % 20 AS kind
                  FROM (SELECT DISTINCT name FROM keyed)),
        damaged AS (
            SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed JOIN kinds USING (name) WHERE kind <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM damaged),
        faults AS (
            SELECT *, left(role, 1) AS r, CASE WHEN mark = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS r0 FROM numbered),
        counts AS (
            SELECT k, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY k),
        back AS (
            SELECT k, n + 1 AS i, {'c': 0, 'a': ''} AS f0, {'c': 4, 'a': 'II'} AS f1, {'c': 2, 'a': 'I'} AS f2, {'c': 0, 'a': ''} AS f3 FROM counts
            UNION ALL
            SELECT k, i, list_min([o0, {'c': o2.c + 2, 'a': 'I' || o2.a}, {'c': o3.c + 4, 'a': 'II' || o3.a}]), list_min([o1, {'c': o2.c + 2, 'a': 'I' || o2.a}, {'c': o3.c + 4, 'a': 'II' || o3.a}]),
                   list_min([o2, {'c': o3.c + 2, 'a': 'I' || o3.a}]), list_min([o3, {'c': o2.c + 2, 'a': 'I' || o2.a}])
            FROM (SELECT b.k, f.i, 
                         list_min([{'c': f0.c + 3, 'a': 'D' || f0.a}, {'c': f2.c + p + 2, 'a': 'R' || f2.a}, {'c': CASE r WHEN 's' THEN f1.c WHEN 'u' THEN f2.c ELSE 1000000000 END + p, 'a': 'K' || CASE r WHEN 's' THEN f1.a ELSE f2.a END}]) AS o0,
                         list_min([{'c': f1.c + 3, 'a': 'D' || f1.a}, {'c': f2.c + p + 2, 'a': 'R' || f2.a}, {'c': CASE r WHEN 'u' THEN f2.c ELSE 1000000000 END + p, 'a': 'K' || f2.a}]) AS o1,
                         list_min([{'c': f2.c + 3, 'a': 'D' || f2.a}, {'c': f3.c + p + 2, 'a': 'R' || f3.a}, {'c': CASE r WHEN 'a' THEN f3.c ELSE 1000000000 END + p, 'a': 'K' || f3.a}]) AS o2,
                         list_min([{'c': f3.c + 3, 'a': 'D' || f3.a}, {'c': f2.c + p + 2, 'a': 'R' || f2.a}, {'c': CASE r WHEN 'u' THEN f2.c ELSE 1000000000 END + p, 'a': 'K' || f2.a}]) AS o3
                  FROM back b JOIN (SELECT k, i, r, CASE fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 1000000000 END AS p FROM faults) f ON f.k = b.k AND f.i = b.i - 1)),
        best AS (SELECT k, f0.c AS cost, f0.a AS audit FROM back WHERE i = 1),
        walk AS (
            SELECT k, 0 AS pos, 0 AS i, '' AS was, NULL::VARCHAR AS said, audit FROM best
            UNION ALL
            SELECT w.k, pos + 1, CASE e WHEN 'I' THEN w.i ELSE w.i + 1 END, CASE e WHEN 'D' THEN was WHEN 'K' THEN f.r ELSE new[1] END,
                   CASE e WHEN 'I' THEN new || ':' WHEN 'R' THEN new || ':' || f.text WHEN 'K' THEN f.role || ':' || f.text END, audit
            FROM (SELECT *, audit[pos + 1] AS e, CASE was WHEN 'u' THEN 'assistant' ELSE 'user' END AS new FROM walk WHERE pos < length(audit)) w LEFT JOIN faults f ON f.k = w.k AND f.i = w.i + 1),
        texts AS (SELECT k, coalesce(string_agg(said, chr(10) ORDER BY pos), '') AS whole FROM walk GROUP BY k)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT k, conv_id FROM keyed) LEFT JOIN counts USING (k) LEFT JOIN best USING (k) LEFT JOIN texts USING (k)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS origin FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN origin <> page_id THEN origin END AS refers_to, NULL::VARCHAR AS error FROM f""",
    "op8_topk": """
        WITH good AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.r <> q.r),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_url_filter": r"""
        WITH parts AS (
            SELECT page_id, coalesce(position('://' IN url), 0) AS mark,
                   regexp_extract(substr(url, position('://' IN url) + 3), '^([^?#]*)', 1) AS rest FROM pages),
        split AS (
            SELECT page_id,
                   CASE WHEN mark = 0 THEN '' ELSE translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
                   CASE WHEN mark = 0 OR position('/' IN rest) = 0 THEN '' ELSE substr(rest, position('/' IN rest)) END AS path FROM parts),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
            FROM split, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM split s LEFT JOIN fits f USING (page_id)""",
}
