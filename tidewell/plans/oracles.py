"""DuckDB SQL for the queries, from shared stages that are stated once."""

from __future__ import annotations

from .queries import ODD_QUERIES

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda t: t <> '')"


def _match(x: str) -> str:
    return f"list_filter(list_transform({_tokens(f'lower({x})')}, lambda t: translate(t, '{_PUNCT}', '')), lambda t: t <> '')"


def _first(x: str) -> str:
    """A list's distinct values in the order of their first places."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _paragraphs(x: str) -> str:
    unix = _strip(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
    return f"list_filter(list_transform(regexp_split_to_array({unix}, '\\n{_WS}*\\n+'), lambda p: {_squeeze('p')}), lambda p: p <> '')"


def _phrases(x: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all({x}, '"([^"]+)"', 1), lambda p: lower({_strip('p')})), lambda p: p <> '')"""


def _digits(x: str) -> str:
    return f"list_filter({x}, lambda t: regexp_matches(t, '\\p{{Nd}}'))"


def _code(x: str) -> str:
    return f"""len(list_filter({x}, lambda t: regexp_matches(t, '[_/\\\\.()\\[\\]]|::') OR (contains(t, '-') AND regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '\\p{{Nd}}'))
        OR regexp_matches(t, '[a-z][A-Z]|[A-Z][a-z].*[0-9]|[0-9].*[A-Za-z]'))) > 0"""


_BM25 = "idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / (SELECT avgdl FROM stats)))"


def _pieces(n: str) -> str:
    return f"ceil(({n} - 30) / 170.0)::BIGINT"


_STAGES = {
    "doc": "SELECT doc_id, text FROM documents",
    "odd": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in ODD_QUERIES) + ") AS t(qid, query)",
    "query": f"SELECT item_id AS qid, array_to_string({_tokens('text')}, ' ') AS query FROM benchmark",
    "page": f"SELECT doc_id AS page_id, array_to_string({_tokens('text')}[1:3], ' ') AS title, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents",
    "para": f"""SELECT page_id, title, i - 1 AS idx, ps[i] AS p, len(string_split(ps[i], ' ')) AS n
        FROM (SELECT page_id, title, {_paragraphs('content')} AS ps FROM page), unnest(range(1, len(ps) + 1)) AS t(i)""",
    "fold": """SELECT page_id, idx, n, n AS cur, 0 AS grp FROM para WHERE idx = 0
        UNION ALL SELECT p.page_id, p.idx, p.n, CASE WHEN f.cur < 140 AND f.cur + p.n <= 200 THEN f.cur + p.n ELSE p.n END,
            f.grp + CASE WHEN f.cur < 140 AND f.cur + p.n <= 200 THEN 0 ELSE 1 END FROM fold f JOIN para p ON p.page_id = f.page_id AND p.idx = f.idx + 1""",
    "merged": "SELECT page_id, min(idx) AS start, sum(f.n)::BIGINT AS n, string_agg(p.p, chr(10) || chr(10) ORDER BY idx) AS text FROM fold f JOIN para p USING (page_id, idx) GROUP BY page_id, grp",
    "sized": f"SELECT *, string_split(text, ' ') AS w, {_pieces('n')} AS k, n + 30 * ({_pieces('n')} - 1) AS spread FROM merged WHERE n > 200",
    "part": "SELECT page_id, start, i, array_to_string(w[i * (spread // k - 30) + least(i, spread % k) + 1 : i * (spread // k - 30) + least(i, spread % k) + spread // k + (i < spread % k)::INT], ' ') AS text FROM sized, unnest(range(k)) AS t(i)",
    "plain": "SELECT page_id, start AS paragraph_index, 0::BIGINT AS subchunk_index, text AS chunk_text FROM merged WHERE n <= 200 UNION ALL SELECT page_id, start, i, text FROM part UNION ALL SELECT page_id, 0, 0, '' FROM page WHERE page_id NOT IN (SELECT page_id FROM para)",
    "chunk": """SELECT row_number() OVER (ORDER BY page_id, paragraph_index, subchunk_index) - 1 AS chunk_idx, page_id,
        row_number() OVER (PARTITION BY page_id ORDER BY paragraph_index, subchunk_index) - 1 AS chunk_id, title, chunk_text, paragraph_index, subchunk_index FROM plain JOIN page USING (page_id)""",
    "word": f"SELECT chunk_idx, page_id, {_tokens('''lower(CASE WHEN title <> '' AND chunk_text <> '' THEN title || chr(10) || chr(10) || chunk_text ELSE title || chunk_text END)''')} AS w FROM chunk",
    "posting": "SELECT term, chunk_idx, page_id, length, count(*) AS tf FROM (SELECT chunk_idx, page_id, len(w) AS length, unnest(w) AS term FROM word) GROUP BY ALL",
    "stats": "SELECT count(*) AS n, avg(len(w)) AS avgdl FROM word",
    "vocab": "SELECT term, count(*) AS df, ln(((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM posting GROUP BY term",
    "asked": f"SELECT DISTINCT qid, unnest({_tokens('lower(query)')}) AS term FROM query",
    "odd_asked": f"SELECT DISTINCT qid, unnest({_tokens('lower(query)')}) AS term FROM odd",
    "bm25": f"SELECT qid, chunk_idx, page_id, round(sum({_BM25.format(k1=1.5, b=0.75)}), 6) AS score FROM asked JOIN posting USING (term) JOIN vocab USING (term) GROUP BY ALL",
    "other": f"SELECT qid, chunk_idx, page_id, round(sum({_BM25.format(k1=0.9, b=0.4)}), 6) AS score FROM asked JOIN posting USING (term) JOIN vocab USING (term) GROUP BY ALL",
    "odd_bm25": f"SELECT qid, chunk_idx, page_id, round(sum({_BM25.format(k1=1.5, b=0.75)}), 6) AS score FROM odd_asked JOIN posting USING (term) JOIN vocab USING (term) GROUP BY ALL",
    "lex": """SELECT q.qid, c.chunk_idx, c.page_id, coalesce(b.score, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(b.score, 0) DESC, c.chunk_idx) AS rank
        FROM query q CROSS JOIN (SELECT chunk_idx, page_id FROM chunk) c LEFT JOIN bm25 b ON b.qid = q.qid AND b.chunk_idx = c.chunk_idx QUALIFY rank <= 160""",
    "hashed": """SELECT kind, id, b, count(*) AS v FROM (
            SELECT 'c' AS kind, chunk_idx AS id, unnest(w) AS t FROM word
            UNION ALL SELECT 'q', qid, unnest(""" + _tokens("lower(query)") + """) FROM query) x, LATERAL (SELECT ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b) GROUP BY ALL""",
    "unit": "SELECT kind, id, b, v / sqrt(sum(v * v) OVER (PARTITION BY kind, id)) AS v FROM hashed",
    "dot": "SELECT q.id AS qid, c.id AS chunk_idx, round(sum(q.v * c.v), 6) AS score FROM unit q JOIN unit c ON q.b = c.b AND q.kind = 'q' AND c.kind = 'c' GROUP BY ALL",
    "den": """SELECT q.qid, c.chunk_idx, c.page_id, coalesce(d.score, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(d.score, 0) DESC, c.chunk_idx) AS rank
        FROM query q CROSS JOIN (SELECT chunk_idx, page_id FROM chunk) c LEFT JOIN dot d ON d.qid = q.qid AND d.chunk_idx = c.chunk_idx QUALIFY rank <= 120""",
    "texts": "SELECT qid, query FROM odd UNION ALL SELECT doc_id + 1000, text FROM documents",
    "bucket": "SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM (SELECT doc_id, unnest(" + _tokens("lower(text)") + ") AS t FROM doc) GROUP BY ALL",
    "bucket_weight": "SELECT b, ln(((SELECT count(*) FROM doc) + 1) / (count(*) + 1)) + 1 AS w FROM bucket GROUP BY b",
    "modelled": "SELECT doc_id, b, c * w / sqrt(sum(c * w * c * w) OVER (PARTITION BY doc_id)) AS v FROM bucket JOIN bucket_weight USING (b)",
    "asked_bucket": "SELECT qid, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM (SELECT qid, unnest(" + _tokens("lower(query)") + ") AS t FROM query) GROUP BY ALL",
    "asked_modelled": "SELECT qid, b, c * coalesce(w, ln((SELECT count(*) FROM doc) + 1) + 1) / sqrt(sum(c * coalesce(w, ln((SELECT count(*) FROM doc) + 1) + 1) * c * coalesce(w, ln((SELECT count(*) FROM doc) + 1) + 1)) OVER (PARTITION BY qid)) AS v FROM asked_bucket LEFT JOIN bucket_weight USING (b)",
    "asking": "SELECT qid, query FROM odd UNION ALL SELECT qid + 1000, query FROM query",
    "said": f"""SELECT qid, query, {_tokens('lower(query)')} AS raw, {_first(_match('query'))} AS terms, {_squeeze('lower(query)')} AS query_text, {_phrases('query')} AS phrases,
        {_digits(_first(_match('query')))} AS digits FROM asking""",
    "rarity": "SELECT qid, least(list_avg(list_reverse_sort(list(idf))[1:3]) / 6, 1.0) AS rare FROM (SELECT qid, unnest(terms) AS term FROM said) JOIN vocab USING (term) GROUP BY qid",
    "profile": f"""SELECT qid, query_text, terms, phrases, digits, coalesce(rare, 0) AS rare, 1.0::DOUBLE AS dense_weight,
        2.0::DOUBLE + least(0.18::DOUBLE * coalesce(rare, 0) + 0.05 * (len(digits) > 0)::INT + 0.07 * (len(phrases) > 0)::INT + 0.05 * (len(terms) <= 3 AND len(raw) <= 4)::INT + 0.07 * ({_code('raw')})::INT, 0.3) AS bm25_weight
        FROM said LEFT JOIN rarity USING (qid)""",
    "fused": """SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.chunk_idx, l.chunk_idx) AS chunk_idx, coalesce(d.page_id, l.page_id) AS page_id, coalesce(d.score, 0)::DOUBLE AS dense_score, coalesce(l.score, 0)::DOUBLE AS bm25_score,
        round(coalesce(1.0::DOUBLE / (5 + d.rank), 0) + coalesce(p.bm25_weight / (5 + l.rank), 0), 6) AS fused
        FROM den d FULL JOIN lex l ON d.qid = l.qid AND d.chunk_idx = l.chunk_idx JOIN profile p ON p.qid = coalesce(d.qid, l.qid) + 1000""",
    "feature": f"""SELECT f.*, c.title, c.chunk_text, q.query,
        CASE WHEN len(p.terms) > 0 THEN len(list_intersect(p.terms, {_match('c.title')})) / len(p.terms) ELSE 0 END AS title_overlap,
        CASE WHEN len(p.terms) > 0 THEN len(list_intersect(p.terms, {_match('c.chunk_text')})) / len(p.terms) ELSE 0 END AS chunk_overlap,
        {_squeeze("lower(c.title || ' ' || c.chunk_text)")} AS body, p.digits
        FROM fused f JOIN chunk c USING (chunk_idx) JOIN query q ON q.qid = f.qid JOIN profile p ON p.qid = f.qid + 1000""",
    "scaled": """SELECT *, CASE WHEN len(digits) > 0 THEN len(list_filter(digits, lambda d: contains(body, d))) / len(digits) ELSE 0 END AS numeric_match,
        """ + ", ".join(f"CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE 0 END AS {c}_n" for c in ("dense_score", "bm25_score", "fused")) + " FROM feature WINDOW q AS (PARTITION BY qid)",
    "scored": "SELECT *, round(0.2::DOUBLE * fused_n + 0.8::DOUBLE * (0.24::DOUBLE * dense_score_n + 0.24::DOUBLE * bm25_score_n + 0.02::DOUBLE * title_overlap + 0.18::DOUBLE * chunk_overlap + 0.3::DOUBLE * numeric_match), 6) AS score FROM scaled",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank FROM scored",
    "marked": """SELECT *, first AND row_number() OVER (PARTITION BY qid ORDER BY first DESC, rank) <= 10 AS is_head
        FROM (SELECT *, row_number() OVER (PARTITION BY qid, page_id ORDER BY rank) = 1 AS first FROM ranked)""",
    "paired": f"""SELECT *, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 6) AS pair
        FROM (SELECT *, {_match('query')} AS a, {_match('''(title || chr(10) || chr(10) || chunk_text)''')} AS b FROM marked WHERE is_head)""",
    "blended": "SELECT *, " + ", ".join(f"CASE WHEN max({c}) OVER q > min({c}) OVER q THEN ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) ELSE 0 END AS {c}_n" for c in ("score", "pair")) + " FROM paired WINDOW q AS (PARTITION BY qid)",
    "final": "SELECT qid, chunk_idx, page_id, is_head, round(0.0::DOUBLE * score_n + 1.0::DOUBLE * pair_n, 6) AS score FROM blended UNION ALL SELECT qid, chunk_idx, page_id, is_head, score FROM marked WHERE NOT is_head",
    "half": "SELECT qid, chunk_idx, page_id, is_head, round(0.5::DOUBLE * score_n + 0.5::DOUBLE * pair_n, 6) AS score FROM blended UNION ALL SELECT qid, chunk_idx, page_id, is_head, score FROM marked WHERE NOT is_head",
    "relevant": "SELECT DISTINCT item_id AS qid, doc_id AS page_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "best": "SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank FROM bm25 QUALIFY rank <= 40",
    "placed": "SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM best GROUP BY qid, page_id",
}


def _with(final: str) -> str:
    stages = _STAGES | {"answered": _listed("final")}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in stages.items()) + "\n" + final


def _digest(column: str, of: str = "doc") -> str:
    return _with(f"SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, {column} AS x FROM {of})")


def _listed(source: str, second: float = 0, third: float = 0) -> str:
    return f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id) AS rank, page_id, score FROM (
        SELECT qid, page_id, round(sum(score * CASE n WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN {second}::DOUBLE ELSE {third}::DOUBLE END), 8) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY qid, page_id ORDER BY score DESC, chunk_idx) AS n FROM {source} QUALIFY n <= 3) GROUP BY qid, page_id) QUALIFY rank <= 10"""


def _pages(source: str, second: float = 0, third: float = 0) -> str:
    return _with(_listed(source, second, third))


def _ndcg(ranked: str, relevant: str, queries: str, shift: int) -> str:
    weight = lambda r: f"CASE WHEN {r} <= 1 THEN 1.0::DOUBLE ELSE log2({r} + {shift}) END"
    return f"""SELECT q.qid, round(coalesce(g.dcg / i.ideal, 0), 6) AS ndcg FROM {queries} q
        LEFT JOIN (SELECT p.qid, sum(CASE WHEN r.page_id IS NULL THEN 0 ELSE 1 END / ({weight('p.rank')})) AS dcg FROM {ranked} p LEFT JOIN {relevant} r ON p.qid = r.qid AND p.page_id = r.page_id WHERE p.rank <= 10 GROUP BY p.qid) g ON g.qid = q.qid
        LEFT JOIN (SELECT qid, sum(1 / ({weight('i')})) AS ideal FROM (SELECT qid, unnest(range(1, least(count(*), 10) + 1)) AS i FROM {relevant} GROUP BY qid) GROUP BY qid) i ON i.qid = q.qid"""


def _own_pages(columns: str) -> str:
    number = f"array_to_string({_digits('w')}[1:1], ' ')"
    ask = f"""(CASE WHEN doc_id % 2 = 0 THEN '"' || array_to_string(w[1:2], ' ') || '" ' ELSE '' END || array_to_string(w[5:8], ' ') || CASE WHEN doc_id % 3 = 0 AND {number} <> '' THEN ' ' || {number} ELSE '' END)"""
    return _with(f"""SELECT qid, chunk_idx, {columns} FROM (
        SELECT a.qid, c.chunk_idx, a.terms, a.phrases, a.digits, a.query_text, {_match('c.title')} AS tt, {_match('c.chunk_text')} AS ct, {_squeeze("lower(c.title || ' ' || c.chunk_text)")} AS body
        FROM chunk c JOIN (SELECT doc_id AS qid, {_first(_match('ask'))} AS terms, {_phrases('ask')} AS phrases, {_digits(_first(_match('ask')))} AS digits, {_squeeze('lower(ask)')} AS query_text
            FROM (SELECT doc_id, {ask} AS ask FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents))) a ON a.qid = c.page_id)""")


_DENSE = """SELECT qid, rank, chunk_idx, score FROM (SELECT q.vec_id AS qid, v.vec_id AS chunk_idx, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0) WHERE rank <= 120"""

_CHUNK_COLUMNS = "page_id, chunk_id, title, paragraph_index, subchunk_index, md5(chunk_text) AS digest FROM chunk"

_EMBEDDED = _with("SELECT id AS chunk_idx, page_id, b AS bucket, round(v, 6) AS value FROM unit JOIN chunk ON id = chunk_idx WHERE kind = 'c'")

_QUERY_SET = "SELECT item_id::VARCHAR AS qid, md5(text) AS digest, {pages} AS pages FROM benchmark"

ORACLES = {
    "norm_whitespace": _with(f"SELECT doc_id, md5({_squeeze('text')}) AS digest FROM doc"),
    "lower_squeeze": _with(f"SELECT doc_id, md5({_squeeze('lower(text)')}) AS digest FROM doc"),
    "tokenize": _digest(_tokens("text")),
    "lower_tokens": _digest(_tokens("lower(text)")),
    "match_tokens": _digest(_match("text")),
    "distinct_tokens": _with(f"""SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(x, '|')) AS digest FROM (
        SELECT doc_id, coalesce(list(t ORDER BY i) FILTER (t IS NOT NULL), []) AS x FROM (SELECT doc_id, t, min(i) AS i FROM (
            SELECT doc_id, unnest({_match('text')}) AS t, generate_subscripts({_match('text')}, 1) AS i FROM doc) GROUP BY doc_id, t) GROUP BY doc_id)"""),
    "untokenize": _with(f"SELECT doc_id, md5(array_to_string({_tokens('text')}, ' ')) AS digest FROM doc"),
    "split_paragraphs": _digest(_paragraphs("replace(text, chr(10), chr(10) || chr(10))")),
    "quoted_phrases": _with(f"SELECT qid, len(x)::BIGINT AS n, array_to_string(x, '|') AS phrases FROM (SELECT qid, {_phrases('query')} AS x FROM texts)"),
    "code_like": _with(f"SELECT qid, {_code(_tokens('lower(query)'))} AS code_like FROM texts"),
    "digit_tokens": _with(f"""SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n, md5(coalesce(x, '')) AS digest FROM doc d LEFT JOIN (
        SELECT doc_id, count(*) AS n, string_agg(t, '|' ORDER BY i) AS x FROM (SELECT doc_id, t, min(i) AS i FROM (
            SELECT doc_id, unnest({_match('text')}) AS t, generate_subscripts({_match('text')}, 1) AS i FROM doc) WHERE regexp_matches(t, '\\p{{Nd}}') GROUP BY doc_id, t) GROUP BY doc_id) USING (doc_id)"""),
    "chunk_text_compose": _with("SELECT page_id, md5(CASE WHEN title <> '' AND content <> '' THEN title || chr(10) || chr(10) || content ELSE title || content END) AS digest, md5(content) AS untitled FROM page"),
    "page_text": _with("SELECT page_id, md5(" + _strip("CASE WHEN title <> '' THEN title || chr(10) || chr(10) || content ELSE content END") + ") AS digest FROM page"),
    "engine_summary": _with("SELECT (SELECT count(DISTINCT page_id) FROM chunk) AS pages, (SELECT n FROM stats) AS chunks, count(*) AS vocab_size, sum(df)::BIGINT AS postings, (SELECT round(avgdl, 6) FROM stats) AS avgdl FROM vocab"),
    "page_id_coerce": _with("SELECT doc_id, trim(' ' || doc_id || ' ')::BIGINT AS page_id FROM doc"),
    "chunk_oversized": _with(f"""SELECT doc_id, i, len(string_split(piece, ' '))::BIGINT AS n, md5(piece) AS digest FROM (
        SELECT doc_id, i, array_to_string(w[i * (spread // k - 30) + least(i, spread % k) + 1 : i * (spread // k - 30) + least(i, spread % k) + spread // k + (i < spread % k)::INT], ' ') AS piece
        FROM (SELECT doc_id, w, {_pieces('len(w)')} AS k, len(w) + 30 * ({_pieces('len(w)')} - 1) AS spread FROM (SELECT doc_id, {_tokens('text')} AS w FROM doc) WHERE len(w) > 200), unnest(range(k)) AS t(i))"""),
    "chunk_merge": _with("SELECT page_id, start, n, md5(text) AS digest FROM merged"),
    "chunk_corpus": _with(f"SELECT chunk_idx, {_CHUNK_COLUMNS}"),
    "chunk_stats": _with(f"SELECT count(*) AS chunks, count(DISTINCT page_id) AS pages, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT page_id, len({_tokens('chunk_text')})::BIGINT AS n FROM chunk)"),
    "udtf_chunks": _with(f"SELECT {_CHUNK_COLUMNS}"),
    "udtf_partitioned": _with(f"SELECT {_CHUNK_COLUMNS}"),
    "generator_chunks": _with(f"SELECT {_CHUNK_COLUMNS}"),
    "incremental_topk": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, page_id, chunk_id, score FROM bm25 JOIN (SELECT chunk_idx, chunk_id FROM chunk) USING (chunk_idx) QUALIFY rank <= 10"),
    "model_embed": _with("SELECT doc_id, b AS bucket, round(v, 6) AS value FROM modelled"),
    "model_pairs": _with("SELECT r.qid, r.page_id, round(coalesce(sum(a.v * m.v), 0), 6) AS score FROM relevant r LEFT JOIN modelled m ON m.doc_id = r.page_id LEFT JOIN asked_modelled a ON a.qid = r.qid AND a.b = m.b GROUP BY r.qid, r.page_id"),
    "term_frequency": _with("SELECT term, chunk_idx, tf FROM posting"),
    "document_frequency": _with("SELECT term, df FROM vocab"),
    "idf": _with("SELECT term, round(idf, 6) AS idf FROM vocab"),
    "corpus_stats": _with("SELECT n, round(avgdl, 6) AS avgdl, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b FROM stats"),
    "builder_counts": _with("SELECT (SELECT n FROM stats) AS num_chunks, count(*) AS vocab_size, sum(df)::BIGINT AS total_postings FROM vocab"),
    "vocab_offsets": _with("SELECT term, df, (sum(df) OVER (ORDER BY term) - df)::BIGINT AS offset FROM vocab"),
    "bm25_scores": _with("SELECT qid, chunk_idx, score FROM bm25"),
    "bm25_topk": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, page_id, score FROM bm25 QUALIFY rank <= 10"),
    "bm25_topk_padded": _with("""SELECT o.qid, row_number() OVER (PARTITION BY o.qid ORDER BY coalesce(b.score, 0) DESC, c.chunk_idx) AS rank, c.chunk_idx, c.page_id, coalesce(b.score, 0)::DOUBLE AS score
        FROM odd o CROSS JOIN chunk c LEFT JOIN odd_bm25 b ON b.qid = o.qid AND b.chunk_idx = c.chunk_idx QUALIFY rank <= 160"""),
    "bm25_params": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, page_id, score FROM other QUALIFY rank <= 10"),
    "vocab_lookup_semi": _with("SELECT DISTINCT term FROM asked WHERE term IN (SELECT term FROM vocab)"),
    "vocab_missing_anti": _with("SELECT DISTINCT term FROM odd_asked WHERE term NOT IN (SELECT term FROM vocab)"),
    "dense_topk": _DENSE,
    "dense_topk_small_k_gt_n": """WITH n AS (SELECT n_nationkey::BIGINT AS k, ('0x' || substr(md5(lower(n_name)), 1, 8))::BIGINT % 64 AS b FROM nation)
        SELECT q.k AS qid, row_number() OVER (PARTITION BY q.k ORDER BY (q.b = v.b)::INT DESC, v.k) AS rank, v.k AS chunk_idx, (q.b = v.b)::INT::DOUBLE AS score FROM n q JOIN n v ON true""",
    "hash_embed": _with(f"""SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM (
        SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS bucket, count(*) AS v FROM (SELECT doc_id, unnest({_tokens('lower(text)')}) AS t FROM doc) GROUP BY ALL)"""),
    "udf_embed_rows": _EMBEDDED,
    "dense_only_build": _EMBEDDED,
    "query_profile": _with("SELECT qid, query_text, array_to_string(terms, '|') AS terms, array_to_string(phrases, '|') AS phrases, array_to_string(digits, '|') AS digits, round(rare, 6) AS rare, round(bm25_weight, 6) AS bm25_weight, dense_weight FROM profile"),
    "bm25_weight": _with("SELECT qid - 1000 AS qid, round(bm25_weight, 6) AS bm25_weight FROM profile WHERE qid >= 1000"),
    "rrf_fusion": _with("SELECT qid, chunk_idx, dense_score, bm25_score, fused FROM fused"),
    "minmax_features": _with("SELECT qid, chunk_idx, round(dense_score_n, 6) AS dense_score, round(bm25_score_n, 6) AS bm25_score, round(fused_n, 6) AS fused FROM scaled"),
    "overlap_features": _own_pages("round(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, tt)) / len(terms) ELSE 0 END, 6) AS title_overlap, round(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, ct)) / len(terms) ELSE 0 END, 6) AS chunk_overlap"),
    "phrase_match": _own_pages("(CASE WHEN len(phrases) > 0 THEN len(list_filter(phrases, lambda p: contains(body, p))) > 0 ELSE len(string_split(query_text, ' ')) >= 2 AND contains(body, query_text) END)::INT::DOUBLE AS phrase_match"),
    "numeric_match": _own_pages("round(CASE WHEN len(digits) > 0 THEN len(list_filter(digits, lambda d: contains(body, d))) / len(digits) ELSE 0 END, 6) AS numeric_match"),
    "linear_rerank": _with("SELECT qid, rank, chunk_idx, score FROM ranked"),
    "ce_head_tail": _with("SELECT qid, rank, chunk_idx, is_head FROM marked"),
    "ce_blend": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, is_head, score FROM final"),
    "ce_model": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, is_head, score FROM final"),
    "ce_weight_half": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, is_head, score FROM half"),
    "page_aggregate_max": _pages("ranked"),
    "page_aggregate_top3": _pages("ranked", 0.2, 0.1),
    "hybrid_search": _pages("final"),
    "qrels": _with("SELECT qid, page_id FROM relevant"),
    "dcg_table": """SELECT doc_id, i AS rank, round(1 / CASE WHEN i <= 1 THEN 1 ELSE log2(i) END, 6) AS shifted, round(1 / CASE WHEN i <= 1 THEN 1 ELSE log2(i + 1) END, 6) AS standard
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)""",
    "ndcg_per_query": _with(_ndcg("placed", "relevant", "query", 0)),
    "ndcg_standard": _with(_ndcg("placed", "relevant", "query", 1)),
    "mean_ndcg": _with(f"SELECT round(avg(ndcg), 6) AS mean_ndcg, count(*) AS num_queries FROM ({_ndcg('placed', 'relevant', 'query', 0)})"),
    "ndcg_duplicates": _with(_ndcg("(SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY page_id DESC) AS rank FROM (SELECT * FROM relevant UNION SELECT qid, page_id + 1 FROM relevant))", "relevant", "query", 0)),
    "alignment_check": _with("SELECT unnest(['postings', 'dense', 'broken']) AS side, unnest([0, 0, (SELECT count(*) FROM chunk WHERE chunk_idx % 7 IN (1, 2))]) AS misaligned"),
    "json_pages_scan": "SELECT doc_id AS page_id, '' AS title, md5(text) AS digest FROM documents",
    "json_page_rejects": """SELECT problem, count(*) AS n, CASE WHEN problem = 'none' THEN sum(doc_id)::BIGINT END AS ids FROM (
        SELECT doc_id, CASE doc_id % 11 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'empty' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'no page id' ELSE 'none' END AS problem FROM documents) GROUP BY problem""",
    "build_metrics": _with("SELECT (SELECT count(DISTINCT page_id) FROM chunk) AS pages, (SELECT count(*) FROM chunk) AS chunks, sum(tf)::BIGINT AS tokens, count(*) AS postings FROM posting"),
    "page_listing": "SELECT count(*) AS files, count(*) AS scanned FROM documents",
    "query_set_sets": _QUERY_SET.format(pages="item_id || '|' || (item_id + 7)"),
    "query_set_lists": _QUERY_SET.format(pages="item_id || '|' || (item_id + 7) || '|' || item_id"),
    "chunks_roundtrip": _with(f"SELECT chunk_idx, {_CHUNK_COLUMNS}"),
    "legacy_index": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, page_id, score FROM bm25 QUALIFY rank <= 10"),
    "engine_evaluate": _with(f"SELECT round(avg(ndcg), 6) AS mean_ndcg, count(*) AS num_queries FROM ({_ndcg('answered', 'relevant', 'query', 0)})"),
    "artifact_roundtrip": _with("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx) AS rank, chunk_idx, page_id, score FROM bm25 QUALIFY rank <= 10"),
}
