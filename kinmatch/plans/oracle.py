"""SQL with the meaning of each registered query, for an independent check."""

from __future__ import annotations

from kinmatch import fixed_values as fixed
from kinmatch.plans.queries import SIZE


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_STOP = "[" + ", ".join(_text(w) for w in fixed.STOP_WORDS) + "]"
_TOKENS = f"regexp_extract_all(lower(text), {_text(fixed.TOKEN_PATTERN)})"
_CONTENT = (
    f"list_filter({_TOKENS}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"
)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _ranked(source: str, keys: str, limit: int) -> str:
    """CTEs ``ranked(keys, token, score, rank)`` over ``source(keys, text)``."""
    return f"""
    lists AS (SELECT {keys}, {_CONTENT} AS tokens FROM {source}),
    placed AS (SELECT {keys}, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos,
                      len(tokens) AS total FROM lists),
    counted AS (SELECT {keys}, token, count(*) AS n, min(pos) AS first, any_value(total) AS total
                FROM placed GROUP BY {keys}, token),
    scored AS (SELECT *, n::DOUBLE / total::DOUBLE
                         + least(length(token)::DOUBLE / 10e0, 5e-1) AS score FROM counted),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, first)::INT
                AS rank FROM scored),
    ranked AS (SELECT * FROM ordered WHERE rank <= {limit})"""


def _places(source: str, key: str, size: int = SIZE) -> str:
    """(key, place, n): hashed token counts of ``source(key, text)``."""
    return f"""
    SELECT {key}, place, count(*)::DOUBLE AS n FROM (
      SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {size} AS place
      FROM (SELECT {key}, unnest({_TOKENS}) AS token FROM {source}))
    GROUP BY {key}, place"""


_SHA = f"sha256({_TRIM.format('text')})"
_DOCS_WITH_VECTORS = (
    "(SELECT d.*, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"
)

# checksums of the vectors that documents have before a backfill
_HALF_FILLED = f"""half AS (SELECT doc_id,
      list_sum(list_transform(embedding, lambda x, i: round(x::DOUBLE * 1000) * i))::BIGINT AS old
      FROM {_DOCS_WITH_VECTORS})"""

_NEAREST_DOCUMENTS = f"""
    doc_places AS ({_places('documents', 'doc_id')}),
    item_places AS ({_places('benchmark', 'item_id')}),
    doc_norms AS (SELECT d.doc_id, coalesce(sum(n * n), 0) AS norm FROM documents d
                  LEFT JOIN doc_places p ON p.doc_id = d.doc_id GROUP BY d.doc_id),
    item_norms AS (SELECT item_id, sum(n * n) AS norm FROM item_places GROUP BY item_id),
    dots AS (SELECT item_id, doc_id, sum(i.n * d.n) AS dot
             FROM item_places i JOIN doc_places d USING (place) GROUP BY item_id, doc_id),
    distances AS (SELECT i.item_id, d.doc_id,
                  CASE WHEN i.norm * d.norm > 0 THEN
                    1e0 - least(1e0, coalesce(dot, 0) / sqrt(i.norm * d.norm))
                  ELSE 'nan'::DOUBLE END AS distance
                  FROM item_norms i CROSS JOIN doc_norms d
                  LEFT JOIN dots ON dots.item_id = i.item_id AND dots.doc_id = d.doc_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id)::INT
             AS rank FROM distances),
    hits AS (SELECT item_id, rank, doc_id, 1e0 - distance / 2e0 AS score FROM near WHERE rank <= 5)"""

_CLEAN_WORDS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]+', '', 'g')"

# the upsert batch and its evaluation
_PART_BATCH = r"""
    batch AS (SELECT p_partkey + 2 AS row_no,
      CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN p_partkey + 100000000000
           ELSE p_partkey END AS key,
      CASE WHEN p_size <= 5 THEN p_name || ' mk2' WHEN p_size <= 10 THEN NULL
           WHEN p_size <= 12 THEN '' ELSE p_name END AS name,
      CASE WHEN p_size BETWEEN 13 AND 15 THEN NULL WHEN p_size BETWEEN 16 AND 18 THEN ''
           WHEN p_size BETWEEN 19 AND 22 THEN 'Brand#99'
           WHEN p_size BETWEEN 23 AND 24 THEN 'Brand#too long' ELSE p_brand END AS brand,
      CASE WHEN p_size BETWEEN 25 AND 27 THEN 'BAD' ELSE p_type END AS kind
      FROM part),
    compared AS (SELECT b.*, p.p_partkey IS NOT NULL AS known, p.p_name, p.p_brand, p.p_type,
      list_filter([
        CASE WHEN length(b.name) > 60 THEN 'p_name: longer than 60' END,
        CASE WHEN length(b.brand) > 10 THEN 'p_brand: longer than 10' END,
        CASE WHEN b.kind LIKE 'BAD%' THEN 'p_type: not a type' END], lambda x: x IS NOT NULL) AS broken,
      list_filter([
        CASE WHEN nullif(b.name, '') IS DISTINCT FROM p.p_name THEN 'p_name: ''' ||
          coalesce(p.p_name, 'None') || ''' → ''' || coalesce(nullif(b.name, ''), 'None') || '''' END,
        CASE WHEN nullif(b.brand, '') IS DISTINCT FROM p.p_brand THEN 'p_brand: ''' ||
          coalesce(p.p_brand, 'None') || ''' → ''' || coalesce(nullif(b.brand, ''), 'None') || '''' END,
        CASE WHEN nullif(b.kind, '') IS DISTINCT FROM p.p_type THEN 'p_type: ''' ||
          coalesce(p.p_type, 'None') || ''' → ''' || coalesce(nullif(b.kind, ''), 'None') || '''' END],
        lambda x: x IS NOT NULL) AS diffs
      FROM batch b LEFT JOIN part p ON p.p_partkey = b.key),
    judged AS (SELECT *, CASE WHEN key IS NULL OR len(broken) > 0 THEN 'error'
      WHEN NOT known THEN 'inserted' WHEN len(diffs) > 0 AND name = '' THEN 'error'
      WHEN len(diffs) > 0 THEN 'updated' ELSE 'skipped' END AS action FROM compared)"""

# the batch applied to records with vectors, by a model that refuses long texts
_PART_RUN = f"""{_PART_BATCH},
    texts AS (SELECT *, action IN ('updated', 'inserted') AS written,
      concat_ws(' ', nullif(CASE WHEN name IS NULL THEN p_name ELSE name END, ''),
        CASE WHEN brand IS NULL THEN p_brand ELSE nullif(brand, '') END, kind) AS text FROM judged),
    run AS (SELECT *, written AND length(text) > 26 AS failed FROM texts)"""

_REPEATED_BATCH = """
    batch AS (SELECT p_partkey * 3 + step + 2 AS row_no,
      p_partkey + CASE WHEN p_size > 45 THEN 100000000000 ELSE 0 END AS key,
      CASE WHEN step = 0 THEN p_name || ' x' WHEN step = 1 THEN NULL
           WHEN p_size < 20 THEN p_name || ' x' ELSE p_name END AS name,
      CASE WHEN step = 0 THEN p_brand WHEN step = 1 THEN 'Brand#7'
           WHEN p_size < 10 THEN 'Brand#7' END AS brand
      FROM part, (SELECT unnest([0, 1, 2]) AS step)),
    states AS (SELECT b.*, p.p_partkey IS NOT NULL AS known,
      row_number() OVER w = 1 AS is_first,
      coalesce(last_value(b.name IGNORE NULLS) OVER before, p.p_name) AS old_name,
      coalesce(last_value(b.brand IGNORE NULLS) OVER before, p.p_brand) AS old_brand
      FROM batch b LEFT JOIN part p ON p.p_partkey = b.key
      WINDOW w AS (PARTITION BY key ORDER BY row_no),
        before AS (PARTITION BY key ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    compared AS (SELECT *, list_filter([
        CASE WHEN name IS DISTINCT FROM old_name THEN 'p_name: ''' || coalesce(old_name, 'None')
          || ''' → ''' || coalesce(name, 'None') || '''' END,
        CASE WHEN brand IS DISTINCT FROM old_brand THEN 'p_brand: ''' || coalesce(old_brand, 'None')
          || ''' → ''' || coalesce(brand, 'None') || '''' END], lambda x: x IS NOT NULL) AS diffs FROM states),
    judged AS (SELECT *, CASE WHEN NOT known AND is_first THEN 'inserted'
      WHEN len(diffs) > 0 THEN 'updated' ELSE 'skipped' END AS action FROM compared)"""


# Scores of parts for the prompts of ``asked(item_id, text)`` with keywords ``ranked``.
# Closeness pairs equal characters one after the other, hence the recursion.
_PART_SCORES = r"""
    texts AS (SELECT *, lower(p_name || ' ' || p_brand || ' ' || p_type) AS content FROM part),
    lists AS (SELECT p_partkey, string_split(content, ' ') AS l FROM texts),
    part_words AS (SELECT p_partkey, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM lists),
    vocabulary AS (SELECT DISTINCT word FROM part_words),
    steps(a, b, i, used, paired) AS (
      SELECT token, word, 0, []::BIGINT[], '' FROM (SELECT DISTINCT token FROM ranked), vocabulary
      UNION ALL
      SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END,
        CASE WHEN j IS NULL THEN paired ELSE paired || substr(a, i + 1, 1) END
      FROM (SELECT *, list_filter(range(greatest(i - reach, 0) + 1, least(i + reach + 1, length(b)) + 1),
              lambda p: substr(b, p, 1) = substr(a, i + 1, 1) AND NOT list_contains(used, p))[1] AS j
            FROM (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach
                  FROM steps WHERE i < length(a)))),
    paired AS (SELECT a, b, len(used)::DOUBLE AS m, length(a)::DOUBLE AS la, length(b)::DOUBLE AS lb,
      len(list_filter(range(1, len(used) + 1),
        lambda k: substr(paired, k, 1) <> substr(b, list_sort(used)[k], 1)))::DOUBLE AS swaps,
      len(list_filter(range(1, 5), lambda k: k <= length(a) AND k <= length(b)
        AND left(a, k) = left(b, k)))::DOUBLE AS prefix
      FROM steps WHERE i = length(a)),
    jaros AS (SELECT *, (m / la + m / lb + (m - swaps / 2e0) / m) / 3e0 AS jaro FROM paired WHERE m > 0),
    closeness AS (SELECT a, b, jaro + prefix * 1e-1 * (1e0 - jaro) AS value FROM jaros),
    first_close AS (SELECT p_partkey, a AS token, arg_min(value, pos) AS value
      FROM part_words JOIN closeness ON b = word WHERE value > 7e-1 GROUP BY p_partkey, a),
    keyword_parts AS (SELECT item_id, t.p_partkey, count(*)::DOUBLE AS n,
      sum(CASE WHEN contains(content, r.token) THEN 4e-1 ELSE 2e-1 * coalesce(value, 0e0) END
        ORDER BY rank) AS total,
      count(*) FILTER (contains(content, r.token))::DOUBLE AS hits
      FROM ranked r CROSS JOIN texts t
      LEFT JOIN first_close f ON f.p_partkey = t.p_partkey AND f.token = r.token
      GROUP BY item_id, t.p_partkey),
    prompt_words AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\s+'),
      lambda x: x <> '')) AS word FROM asked),
    links AS (SELECT DISTINCT p.word, w.p_partkey FROM (SELECT DISTINCT word FROM prompt_words) p
      JOIN vocabulary v ON contains(p.word, v.word) OR contains(v.word, p.word)
      JOIN part_words w ON w.word = v.word),
    commons AS (SELECT item_id, p_partkey, count(*)::DOUBLE AS common
      FROM prompt_words JOIN links USING (word) GROUP BY item_id, p_partkey),
    sizes AS (SELECT a.item_id, count(word)::DOUBLE AS n FROM asked a
      LEFT JOIN prompt_words USING (item_id) GROUP BY a.item_id),
    part_scores AS (SELECT s.item_id, t.p_partkey, t.p_retailprice, least(1e0,
        coalesce(total + hits / k.n * 3e-1, 0e0)
        + CASE WHEN s.n > 0 THEN coalesce(common, 0e0) / s.n * 3e-1 ELSE 0e0 END) AS score
      FROM sizes s CROSS JOIN texts t
      LEFT JOIN keyword_parts k ON k.item_id = s.item_id AND k.p_partkey = t.p_partkey
      LEFT JOIN commons c ON c.item_id = s.item_id AND c.p_partkey = t.p_partkey),
    part_ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id
      ORDER BY score DESC, p_retailprice DESC, p_partkey)::INT AS place FROM part_scores)"""


def _count_message() -> str:
    parts = ", ".join(
        f"CASE WHEN {a}_count > 0 THEN {_text(label)} || ' ' || {a}_count || {_text(fixed.COUNT_UNIT)} END"
        for a, label in fixed.COUNT_LABELS.items()
    )
    return f"{_text(fixed.DONE_PREFIX)} || concat_ws(', ', {parts})"


def _windows(size: int) -> str:
    return f"""
    WITH w AS (SELECT *, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS history FROM conversations),
    m AS (SELECT conv_id, turn, list_concat(list_concat(
        CASE WHEN role = 'assistant' THEN ['system: be brief', 'system: ' || {_text(fixed.CONTEXT_PREFIX)} || 'found']
             ELSE ['system: be brief'] END, coalesce(history, [])), ['user: ' || text]) AS messages FROM w)
    SELECT conv_id, turn, len(messages) AS n_messages,
           md5(array_to_string(messages, '|')) AS messages_md5 FROM m"""


def _knn(k: int, where: str = "") -> str:
    return f"""
    WITH d AS (SELECT q.vec_id AS query_id, r.vec_id,
        1 - list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
        FROM embeddings q, embeddings r),
    s AS (SELECT *, 1 - distance / 2e0 AS score FROM d),
    o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT
          AS rank, vec_id, distance, score FROM s {where})
    SELECT query_id, rank, vec_id, distance, score FROM o WHERE rank <= {k}"""


_TOP = """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    d AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance
          FROM embeddings, q)
    SELECT vec_id, distance, 1 - distance / 2e0 AS score FROM d"""
_PREFIX = _text(fixed.SUMMARY_PREFIX)
_BLANK = r"regexp_full_match({}, '\s*')"
_USER = "conversations WHERE role = 'user'"
_TOOL_ARGS = """CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'find ' || props
      WHEN event_type = 'click' THEN '{"query": ["click", ' || user_id || '], "max_results": "' || (event_id % 20) || '"}'
      WHEN event_type = 'view' AND event_id % 3 = 0
        THEN '{"query": ' || user_id || ', "max_results": ' || (event_id % 20) || '.75}'
      WHEN event_type = 'view' THEN '{"query": "seen", "max_results": "many"}'
      WHEN event_type = 'purchase' THEN '{"file_path": "/in/' || (event_id % 20) || '.xlsx", "query": null}'
      ELSE props END"""
_TOOL_NAME = """CASE event_type WHEN 'purchase' THEN 'update_projects_from_excel'
      WHEN 'error' THEN 'find' || (event_id % 20) WHEN 'signup' THEN NULL ELSE 'recommend_projects' END"""
_FILE = "|".join(fixed.FILE_INTENT_PATTERNS)
_SEARCH = "|".join(fixed.SEARCH_INTENT_PATTERNS)

ORACLE = {
    "vector_topk": f"{_TOP} ORDER BY distance, vec_id LIMIT 10",
    "vector_topk_threshold": f"SELECT * FROM ({_TOP}) WHERE score >= 0.55",
    "vector_knn_batch": _knn(5),
    "vector_knn_signed": """
    WITH v AS (SELECT vec_id, vec_id % 11 <> 5 AND vec_id % 5 <> 0 AS directed,
        list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 5 = 1 THEN -x ELSE x END) AS e
        FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, r.vec_id, CASE WHEN q.directed AND r.directed
        THEN 1 - list_cosine_similarity(r.e, q.e) END AS distance FROM v q, v r),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY distance NULLS LAST, vec_id)::INT AS rank FROM d)
    SELECT query_id, rank, vec_id, distance, 1 - distance / 2e0 AS score FROM o WHERE rank <= 5""",
    "vector_knn_threshold": _knn(10, "WHERE score >= 0.65"),
    "vector_dim_repair": """
    SELECT vec_id, len(list_resize(embedding, 80, 0))::BIGINT AS padded_size,
      round(list_sum(list_resize(embedding::DOUBLE[], 80, 0)), 9) AS padded_sum,
      len(list_resize(embedding, 32, 0))::BIGINT AS cut_size,
      round(list_sum(list_resize(embedding::DOUBLE[], 32, 0)), 9) AS cut_sum FROM embeddings""",
    "tokenize": f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)""",
    "content_tokens": f"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {_CONTENT} AS t FROM documents)""",
    "extract_keywords": f"""
    WITH {_ranked('documents', 'doc_id', 10)} SELECT doc_id, rank, token, score FROM ranked""",
    "noun_keywords": f"""
    WITH t AS (SELECT conv_id, turn, list_filter({_TOKENS}, lambda t: length(t) >= 2) AS l FROM conversations),
    u AS (SELECT conv_id, turn, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM t),
    f AS (SELECT conv_id, turn, token, min(pos) AS pos FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank FROM f),
    n AS (SELECT conv_id, turn, string_agg(token, ' ' ORDER BY rank) AS nouns FROM r WHERE rank <= 5
          GROUP BY ALL)
    SELECT t.conv_id, t.turn, coalesce(nouns, '') AS nouns FROM t
    LEFT JOIN n ON n.conv_id = t.conv_id AND n.turn = t.turn""",
    "embedding_text": """
    SELECT p_partkey, concat_ws(' ', trim(p_name), CASE WHEN p_size > 10 THEN trim(p_brand) END,
      CASE WHEN p_size <= 40 THEN trim(p_type) END) AS content FROM part""",
    "text_presentation": f"""
    SELECT doc_id AS "docId",
      CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS "shortText",
      md5(replace({_PREFIX} || text || {_PREFIX}, {_PREFIX}, '')) AS "withoutPrefix",
      md5(regexp_replace(text || {_PREFIX}, '^\\s+', '')) AS "withoutLeadingPrefix",
      round_even(n_chars / 7777e0 * 100, 0) / 100 AS score,
      printf('%.2f', round_even(n_chars / 7777e0 * 100, 0) / 100) AS "scoreText" FROM documents""",
    "matched_keywords": f"""
    WITH asked AS (SELECT * FROM {_USER}), {_ranked('asked', 'conv_id, turn', 10)},
    k AS (SELECT conv_id, turn, list(token ORDER BY rank) AS keywords FROM ranked GROUP BY ALL),
    j AS (SELECT a.conv_id, a.turn, coalesce(keywords, []) AS keywords,
          {_CLEAN_WORDS.format('r.text')} AS words
          FROM asked a JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1
          LEFT JOIN k ON k.conv_id = a.conv_id AND k.turn = a.turn)
    SELECT conv_id, turn, array_to_string(keywords, ' ') AS keywords,
      array_to_string(list_filter(keywords, lambda k: contains(words, k)), ' ') AS matched FROM j""",
    "ordered_scan": "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey",
    "filter_category": """
    SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey""",
    "filter_grade": """
    SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F'""",
    "lookup_keys": """
    SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS found
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "detail_documents": f"""
    SELECT k.doc_id * 2 AS doc_id, d.doc_id IS NOT NULL AS found, CASE WHEN d.doc_id IS NULL
      THEN replace({_text(fixed.NOT_FOUND_MESSAGE)}, '{{}}', (k.doc_id * 2)::VARCHAR)
      ELSE to_json({{'docId': d.doc_id, 'lang': d.lang, 'nChars': d.n_chars, 'overview': coalesce(d.source, '')}})::VARCHAR
      END AS document
    FROM documents k LEFT JOIN documents d ON d.doc_id = k.doc_id * 2""",
    "keyword_search_one": """
    SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')
      OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""",
    "keyword_search_wildcard": """
    SELECT p_partkey, p_name FROM part
    WHERE lower(p_name) LIKE '%r_d%o%' OR lower(p_type) LIKE '%r_d%o%'""",
    "keyword_search": """
    WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part),
    m AS (SELECT keyword, p.*, row_number() OVER (PARTITION BY keyword
            ORDER BY p_retailprice DESC, p_partkey)::INT AS rank
          FROM k JOIN part p ON contains(lower(p_name), lower(keyword))
            OR contains(lower(p_brand), lower(keyword)) OR contains(lower(p_type), lower(keyword)))
    SELECT keyword, rank, p_partkey,
      CASE WHEN length(p_name) > 6 THEN left(p_name, 6) || '...' ELSE p_name END AS name
    FROM m WHERE rank <= 10""",
    "keyword_search_documents": f"""
    WITH {_ranked('benchmark', 'item_id', 10)}, k AS (SELECT DISTINCT token AS keyword FROM ranked),
    m AS (SELECT keyword, doc_id, text, row_number() OVER (PARTITION BY keyword
            ORDER BY n_chars DESC, doc_id)::INT AS rank
          FROM k JOIN documents ON contains(lower(text), keyword) OR contains(lower(source), keyword))
    SELECT keyword, rank, doc_id,
      md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS overview
    FROM m WHERE rank <= 10""",
    "embedding_status": f"""
    SELECT count(*) AS total, count(embedding) AS with_embedding,
      count(*) - count(embedding) AS without_embedding FROM {_DOCS_WITH_VECTORS}""",
    "missing_embeddings": """
    SELECT doc_id, lang, n_chars FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)""",
    "category_distribution": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "domain_distribution": """
    SELECT v AS o_orderstatus, count(o_orderkey) AS n
    FROM (SELECT unnest(['F', 'O', 'X']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY v""",
    "record_stats": f"""
    SELECT 'total' AS metric, NULL::VARCHAR AS value, count(*) AS n FROM documents
    UNION ALL SELECT 'with_embedding', NULL, count(embedding) FROM {_DOCS_WITH_VECTORS}
    UNION ALL SELECT 'without_embedding', NULL, count(*) - count(embedding) FROM {_DOCS_WITH_VECTORS}
    UNION ALL SELECT 'category', source, count(*) FROM documents GROUP BY source
    UNION ALL SELECT 'domain', v, count(doc_id)
      FROM (SELECT unnest(['en', 'fr', 'xx']) AS v) LEFT JOIN documents ON lang = v GROUP BY v""",
    "stats_document": f"""
    WITH d AS (SELECT * FROM {_DOCS_WITH_VECTORS}),
    c AS (SELECT coalesce(source, 'null') AS k, count(*) AS n FROM d GROUP BY k),
    g AS (SELECT v AS k, count(doc_id) AS n FROM (SELECT unnest(['en', 'fr', 'xx']) AS v) LEFT JOIN d ON lang = v GROUP BY v)
    SELECT to_json({{'totalProjects': count(*), 'withEmbedding': count(embedding),
      'withoutEmbedding': count(*) - count(embedding),
      'industryDistribution': (SELECT map_from_entries(list((k, n) ORDER BY k)) FROM c),
      'gradeDistribution': (SELECT map_from_entries(list((k, n) ORDER BY k)) FROM g)}})::VARCHAR AS document
    FROM d""",
    "embed_texts": f"""
    WITH p AS ({_places('documents', 'doc_id')}),
    s AS (SELECT doc_id, sum(n) AS n, sum(n * (place + 1)) AS c, sum(n * n) AS q FROM p GROUP BY doc_id)
    SELECT d.doc_id, {SIZE}::BIGINT AS size, coalesce(n, 0)::BIGINT AS n_tokens,
      coalesce(c, 0)::BIGINT AS checksum, coalesce(q, 0)::BIGINT AS squared_norm, true AS ok
    FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""",
    "embed_store_stats": f"""
    WITH k AS (SELECT {_SHA} AS sha, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
    g AS (SELECT sha, count(*) AS n, bool_or(labelled) AS known FROM k GROUP BY sha),
    t AS (SELECT sum(n)::BIGINT AS lookups, count(*) FILTER (NOT known) AS misses FROM g)
    SELECT lookups, lookups - misses AS hits, misses,
      printf('%.1f%%', (lookups - misses)::DOUBLE / lookups * 100) AS hit_rate FROM t""",
    "embed_store_extend": f"""
    WITH k AS (SELECT doc_id, {_SHA} AS sha, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
    g AS (SELECT sha, min(doc_id) AS doc_id FROM k GROUP BY sha HAVING NOT bool_or(labelled)),
    p AS ({_places('documents', 'doc_id')}),
    s AS (SELECT doc_id, sum(n * n) AS q FROM p GROUP BY doc_id)
    SELECT sha AS text_sha, coalesce(q, 0)::BIGINT AS squared_norm FROM g LEFT JOIN s USING (doc_id)""",
    "embed_store_lookup": f"""
    WITH k AS (SELECT doc_id, {_SHA} AS sha FROM documents),
    p AS ({_places('documents', 'doc_id')}),
    s AS (SELECT doc_id, sum(n * n) AS q FROM p GROUP BY doc_id),
    t AS (SELECT k.*, sha IN (SELECT sha FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) AS stored FROM k)
    SELECT doc_id, stored, CASE WHEN stored THEN coalesce(q, 0)::BIGINT END AS squared_norm
    FROM t LEFT JOIN s USING (doc_id)""",
    "embed_backfill": f"""
    WITH {_HALF_FILLED},
    full_texts AS (SELECT doc_id, concat_ws(' ', nullif({_TRIM.format('text')}, ''), nullif({_TRIM.format('source')}, '')) AS text FROM documents),
    p AS ({_places('full_texts', 'doc_id', 64)}),
    s AS (SELECT doc_id, sum(n * (place + 1))::BIGINT AS c FROM p GROUP BY doc_id)
    SELECT doc_id, 64::BIGINT AS size, CASE WHEN old IS NOT NULL THEN old ELSE coalesce(c, 0) END AS checksum, '' AS error
    FROM half LEFT JOIN s USING (doc_id)""",
    "attach_vectors": f"""
    WITH {_HALF_FILLED},
    p AS ({_places('documents', 'doc_id', 64)}),
    s AS (SELECT doc_id, sum(n * (place + 1))::BIGINT AS c FROM p GROUP BY doc_id),
    h AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM half)
    SELECT doc_id, old IS NOT NULL OR labelled AS filled, labelled::BIGINT AS updated_at,
      CASE WHEN labelled THEN coalesce(c, 0) ELSE old END AS checksum
    FROM h LEFT JOIN s USING (doc_id)""",
    "recommend_vector": f"""
    WITH {_ranked('benchmark', 'item_id', 10)}, {_NEAREST_DOCUMENTS.replace('rank', 'near_rank')},
    k AS (SELECT item_id, list(token ORDER BY rank) AS keywords FROM ranked GROUP BY item_id),
    w AS (SELECT h.*, coalesce(keywords, []) AS keywords,
          {_CLEAN_WORDS.format("text || ' ' || source")} AS words
          FROM hits h JOIN documents d ON d.doc_id = h.doc_id LEFT JOIN k ON k.item_id = h.item_id)
    SELECT item_id, near_rank AS rank, doc_id, score,
      array_to_string(list_filter(keywords, lambda k: contains(words, k)), ' ') AS matched FROM w""",
    "recommend_documents": f"""
    WITH {_NEAREST_DOCUMENTS}
    SELECT item_id, count(*) AS total, min(doc_id) FILTER (rank = 1) AS first_doc,
      round_even(min(score) FILTER (rank = 1) * 100, 0) / 100 AS first_score
    FROM hits GROUP BY item_id""",
    "recommend_keyword": f"""
    WITH RECURSIVE asked AS (SELECT * FROM benchmark),
    {_ranked('asked', 'item_id', 10).replace('lists AS', 'token_lists AS').replace('FROM lists', 'FROM token_lists')},
    {_PART_SCORES},
    k AS (SELECT item_id, list(token ORDER BY rank) AS keywords FROM ranked GROUP BY item_id),
    w AS (SELECT h.*, coalesce(keywords, []) AS keywords,
          {_CLEAN_WORDS.format("p_name || ' ' || p_brand || ' ' || p_type")} AS words
          FROM part_ranks h JOIN part p ON p.p_partkey = h.p_partkey
          LEFT JOIN k ON k.item_id = h.item_id WHERE place <= 5)
    SELECT item_id, place AS rank, p_partkey, score,
      array_to_string(list_filter(keywords, lambda k: contains(words, k)), ' ') AS matched FROM w""",
    "recommend_routed": f"""
    WITH RECURSIVE long_items AS (SELECT * FROM benchmark WHERE length({_TRIM.format('text')}) > 200),
    short_items AS (SELECT * FROM benchmark WHERE length({_TRIM.format('text')}) <= 200),
    asked AS (SELECT * FROM long_items),
    {_ranked('asked', 'item_id', 10).replace('lists AS', 'token_lists AS').replace('FROM lists', 'FROM token_lists')},
    {_PART_SCORES},
    part_texts AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part),
    part_places AS ({_places('part_texts', 'p_partkey')}),
    item_places AS ({_places('short_items', 'item_id')}),
    part_norms AS (SELECT p_partkey, sum(n * n) AS norm FROM part_places GROUP BY p_partkey),
    item_norms AS (SELECT item_id, sum(n * n) AS norm FROM item_places GROUP BY item_id),
    dots AS (SELECT item_id, p_partkey, sum(i.n * p.n) AS dot
             FROM item_places i JOIN part_places p USING (place) GROUP BY item_id, p_partkey),
    near AS (SELECT i.item_id, p.p_partkey,
               1e0 - least(1e0, coalesce(dot, 0) / sqrt(i.norm * p.norm)) AS distance
             FROM item_norms i CROSS JOIN part_norms p
             LEFT JOIN dots ON dots.item_id = i.item_id AND dots.p_partkey = p.p_partkey),
    near_ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, p_partkey)::INT
                   AS place FROM near),
    hits AS (SELECT item_id, 'vector' AS path, place AS number, p_partkey, 1e0 - distance / 2e0 AS score
             FROM near_ranks WHERE place <= 5
             UNION ALL SELECT item_id, 'keyword', place, p_partkey, score FROM part_ranks WHERE place <= 5)
    SELECT item_id, path, number, h.p_partkey,
      CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS short_name,
      printf('%.2f', round_even(score * 100, 0) / 100) AS score_text FROM hits h JOIN part p ON p.p_partkey = h.p_partkey""",
    "upsert_changes": f"""
    WITH {_PART_BATCH}
    SELECT row_no, coalesce(key::VARCHAR, '') AS p_partkey, action,
      CASE WHEN action = 'updated' THEN array_to_string(diffs, '; ') ELSE '' END AS changed,
      CASE WHEN key IS NULL THEN 'row ' || row_no || ': key is blank'
           WHEN len(broken) > 0 THEN array_to_string(broken, '; ')
           WHEN action = 'error' THEN 'p_name: missing' ELSE '' END AS errors FROM judged""",
    "upsert_merged": f"""
    WITH {_PART_BATCH},
    u AS (SELECT * FROM judged WHERE action IN ('updated', 'inserted'))
    SELECT p.p_partkey, CASE WHEN u.name IS NOT NULL THEN u.name ELSE p.p_name END AS p_name,
      CASE WHEN u.brand IS NOT NULL THEN nullif(u.brand, '') ELSE p.p_brand END AS p_brand,
      p.p_type, p.p_size, p.p_retailprice, 0::BIGINT AS created_at,
      (u.key IS NOT NULL)::BIGINT AS updated_at, u.key IS NOT NULL AS _written
    FROM part p LEFT JOIN u ON u.key = p.p_partkey
    UNION ALL
    SELECT key, coalesce(name, ''), nullif(brand, ''), kind, NULL, NULL, 1, 1, true
    FROM u WHERE action = 'inserted'""",
    "upsert_reembedded": f"""
    WITH {_PART_RUN},
    t AS (SELECT key, failed, action, len({_TOKENS})::BIGINT AS n FROM run WHERE written)
    SELECT p_partkey, CASE WHEN n IS NULL OR failed THEN -1 ELSE n END AS n_tokens,
      CASE WHEN failed THEN 'text too long' ELSE '' END AS embed_error
    FROM part LEFT JOIN t ON key = p_partkey
    UNION ALL SELECT key, CASE WHEN failed THEN 0 ELSE n END, CASE WHEN failed THEN 'text too long' ELSE '' END
    FROM t WHERE key >= 100000000000""",
    "upsert_summary": f"""
    WITH {_PART_RUN},
    o AS (SELECT row_no, key, CASE WHEN failed THEN 'error' ELSE action END AS action,
      CASE WHEN failed THEN 'text too long' WHEN key IS NULL THEN 'row ' || row_no || ': key is blank'
        WHEN len(broken) > 0 THEN array_to_string(broken, '; ') ELSE 'p_name: missing' END AS why FROM run),
    c AS (SELECT count(*) AS n, count(*) FILTER (action = 'inserted') AS inserted_count,
      count(*) FILTER (action = 'updated') AS updated_count,
      count(*) FILTER (action = 'skipped') AS skipped_count,
      count(*) FILTER (action = 'error') AS error_count FROM o)
    SELECT 'summary' AS section, 0::BIGINT AS row_no, '' AS id, {_count_message()} AS message, n FROM c
    UNION ALL SELECT 'count', 0, unnest(['inserted', 'updated', 'skipped', 'error']), '',
      unnest([inserted_count, updated_count, skipped_count, error_count]) FROM c
    UNION ALL SELECT action, row_no, coalesce(key::VARCHAR, ''), CASE WHEN action = 'error' THEN why ELSE '' END, 1
    FROM o WHERE action <> 'skipped'""",
    "upsert_repeated_keys": f"""
    WITH {_REPEATED_BATCH}
    SELECT row_no, key::VARCHAR AS p_partkey, action,
      CASE WHEN action = 'updated' THEN array_to_string(diffs, '; ') ELSE '' END AS changed FROM judged""",
    "upsert_repeated_merged": f"""
    WITH {_REPEATED_BATCH},
    f AS (SELECT key, arg_max(name, row_no) FILTER (name IS NOT NULL) AS name,
      arg_max(brand, row_no) FILTER (brand IS NOT NULL) AS brand
      FROM judged WHERE action <> 'skipped' GROUP BY key)
    SELECT p_partkey, coalesce(name, p_name) AS p_name, coalesce(brand, p_brand) AS p_brand, p_size
    FROM part LEFT JOIN f ON key = p_partkey
    UNION ALL SELECT key, name, brand, NULL FROM f WHERE key >= 100000000000""",
    "batch_append": """
    WITH items AS (SELECT l_partkey + l_linenumber * 1000 AS key, l_orderkey * 10 + l_linenumber AS seq
                   FROM lineitem),
    m AS (SELECT *, key NOT IN (SELECT p_partkey FROM part)
            AND seq = min(seq) OVER (PARTITION BY key) AS fits FROM items)
    SELECT key, fits, count(*) AS n, min(seq) AS first_seq FROM m GROUP BY key, fits""",
    "batch_delete": """
    SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "batch_overwrite": """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || quality END AS lang,
      CASE WHEN l.doc_id IS NULL THEN source END AS source, (l.doc_id IS NOT NULL)::BIGINT AS updated_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "record_rules": """
    SELECT p_partkey, concat_ws('; ', CASE WHEN length(p_name) > 9 THEN 'p_name: longer than 9' END,
      CASE WHEN p_type NOT IN ('SMALL', 'LARGE', 'PROMO') THEN 'p_type: not allowed' END) AS failed
    FROM part""",
    "intent_route": f"""
    WITH m AS (SELECT *, CASE WHEN length(text) < 40 THEN '' ELSE text END AS message FROM {_USER})
    SELECT conv_id, turn, CASE
      WHEN length(text) < 100 AND (message = '' OR regexp_matches(message, {_text(_FILE)}, 'i')) THEN 'file'
      WHEN length(text) > 350 THEN 'tool'
      WHEN regexp_matches(message, {_text(_SEARCH)}, 'i') THEN 'fallback_search' ELSE 'chat' END AS route
    FROM m""",
    "request_validation": f"""
    SELECT conv_id, turn, CASE WHEN length(text) < 60 AND length(text) >= 40 THEN 'blank message'
      WHEN turn * 5 - 5 < 0 THEN 'negative limit' ELSE '' END AS problem,
      CASE WHEN turn * 5 - 5 >= 0 THEN least(turn * 5 - 5, {fixed.MAX_RESULTS}) END::INT AS result_limit
    FROM {_USER}""",
    "tool_args": f"""
    WITH r AS (SELECT event_id, {_TOOL_ARGS} AS raw, coalesce({_TOOL_NAME}, '') AS name FROM events),
    j AS (SELECT *, json_valid(raw) AS ok, name = 'recommend_projects' AS asks FROM r)
    SELECT event_id, name,
      CASE WHEN NOT asks THEN '' WHEN ok THEN coalesce(json_extract_string(raw, '$.query'), '') ELSE raw END AS query,
      CASE WHEN name = 'update_projects_from_excel' AND ok THEN coalesce(json_extract_string(raw, '$.file_path'), '')
           ELSE '' END AS file_path,
      CASE WHEN name IN ('recommend_projects', 'update_projects_from_excel') THEN ''
           ELSE {_text(fixed.UNKNOWN_TOOL)} || name END AS reply,
      CASE WHEN NOT asks THEN -1 WHEN ok
        THEN coalesce(trunc(TRY_CAST(json_extract_string(raw, '$.max_results') AS DOUBLE))::INT, {fixed.DEFAULT_RESULTS})
        ELSE {fixed.DEFAULT_RESULTS} END AS max_results FROM j""",
    "context_window": _windows(10),
    "context_window_short": _windows(3),
    "json_result": """
    SELECT o_orderkey AS "orderKey", to_json({'orderKey': o_orderkey, 'orderStatus': o_orderstatus,
      'priority': o_orderpriority})::VARCHAR AS json FROM orders""",
    "batch_files": """
    SELECT p_partkey::VARCHAR AS project_code, p_name AS project_name,
      CASE WHEN p_partkey % 4 = 2 THEN '' ELSE p_type END AS kind,
      CASE WHEN p_partkey % 4 = 2 THEN 'project_code project_name' ELSE 'kind project_code project_name' END AS present,
      '' AS problem FROM part WHERE p_partkey % 4 <> 3
    UNION ALL SELECT '', '', '', '', 'required columns are missing: project_code'""",
}
