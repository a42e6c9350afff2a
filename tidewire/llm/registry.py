"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from tidewire.llm import chat, collocations, embeddup, infill, langid, minhash, pii, quality, topk, urlfilter
from tidewire.llm.common import table
from tidewire.llm.packing import pack_documents
from tidewire.llm.sentencepieces import piece_digests
from tidewire.llm.tokencount import token_counts


def op1_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_embedding_dedup(spark, sf_dir):
    return embeddup.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op3_minhash_dedup(spark, sf_dir):
    return minhash.near_documents(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, "tidewire", count_col="n_entities")


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_chat(spark, sf_dir):
    given = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(given)
    return chat.read_back(chat.prefix_target_examples(turns))


def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sentencepiece(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_fill_in_middle(spark, sf_dir):
    return infill.infill_digests(table(spark, sf_dir, "documents"))


#: the query's rules; a URL that one of them decides is a labelled one
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op12_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), [urlfilter.parse_rule(r) for r in URL_RULES])


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_topk_search": op1_topk_search,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_packing": op5_packing,
        "op6_chat": op6_chat,
        "op7_token_counts": op7_token_counts,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_quality": op9_quality,
        "op10_language": op10_language,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_url_filter": op12_url_filter,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


#: From the contract alone: what reading the formatted conversations back must give.
OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w AS k,
    6 + length(role) + length(text) + 4 + length(regexp_replace(role || text, '[^\\\\<\\[\\]]', '', 'g')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
    k = max(k) OVER (PARTITION BY conv_id) AS final FROM e
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
    sum(upto) FILTER (role = 'assistant' OR final) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


#: Brute force over all pairs of a query and a candidate.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.x AS x, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Brute force over all pairs, and a recursive walk along the links.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), walk(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT w.a, e.b FROM walk w JOIN e ON w.b = e.a
), c AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n_links, 0) AS n_links, component_id,
  coalesce(d.vec_id = component_id, false) AS kept
FROM embeddings d LEFT JOIN c ON c.a = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""


#: Cuts and forms from the contract alone; a text is restored to itself.
OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS u, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS v,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(u, v) AS p, abs(u - v) AS m,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, substring(text, 1, p) AS prefix, substring(text, p + 1, m) AS middle, substring(text, p + m + 1) AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""

#: All n-grams counted by a plain GROUP BY.
OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k))
), f AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY lang, k, g
), often AS (SELECT * FROM f WHERE f >= 30),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, g, f AS a, unnest(range(1, k)) AS cut_at FROM often WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut_at, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS score
  FROM cuts c JOIN often l ON l.lang = c.lang AND l.g = c.g[1:c.cut_at] JOIN often r ON r.lang = c.lang AND r.g = c.g[c.cut_at + 1:]
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1
), longer AS (
  SELECT lang, f, array_to_string(g[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, f, g, size, unnest(range(1, k - size + 2)) AS i FROM often, (VALUES (2), (3)) s(size) WHERE size < k)
), within AS (
  SELECT lang, phrase, max(f) AS f FROM longer GROUP BY lang, phrase
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN within i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * s.a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def oracle_sql():
    return {"op1_topk_search": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op6_chat": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op13_collocations": OP13_SQL}
