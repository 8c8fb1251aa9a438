"""One registered query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import (
    chat_format,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    mixing,
    ngram_jaccard,
    pieces,
    quality_ranker,
    quality_rules,
    sharding,
    structure_repair,
    warc,
)
from kinmatch.llm.shared import crc32_of, read_table

#: Where the vocabulary file lies on the driver.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a shard at most.
SHARD_BYTES = 1 << 20
CONTROL = r"\### Assistant: </turn> ok"


def op1_extendible_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf, "documents"), SHARD_BYTES)


def op2_sampled_pieces(spark: SparkSession, sf: str) -> DataFrame:
    words = pieces.Vocabulary(MODEL_FILE)
    texts = read_table(spark, sf, "documents").select("doc_id", "text")
    coded = pieces.encoded(texts, words, lossless_col="lossless")
    return coded.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "lossless",
    )


def held_out(id_col: str) -> Column:
    """The fold that nothing is learned from; a null id is not in it."""
    return F.coalesce(crc32_of(id_col) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents")
    return language_id.identified(documents, held_out("doc_id"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, sf, "documents"))


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    given = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(given.dtypes)
    own = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat_format.read_back(chat_format.formatted(given.unionByName(own)))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_jaccard.linked_documents(read_table(spark, sf, "documents"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judged_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf, "documents"))


def op9_quality_ranker(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    rows = quality_ranker.ranked(documents, labels, held_out("doc_id"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.licences(read_table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    return structure_repair.repaired(structure_repair.damaged(read_table(spark, sf, "conversations")))


def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.write(read_table(spark, sf, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_extendible_sharding,
        op2_sampled_pieces,
        op3_language_id,
        op4_mixing,
        op5_chat_format,
        op6_ngram_jaccard,
        op7_quality_rules,
        op8_exact_dedup,
        op9_quality_ranker,
        op10_license_scan,
        op11_hard_negatives,
        op12_structure_repair,
        op13_warc,
    )
}

ORACLE = {
    "op1_extendible_sharding": f"""
WITH sizes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS hash
  FROM documents
), levels AS (
  SELECT d.depth, substr(hash, 1, d.depth) AS shard, sum(bytes) AS total, count(*) AS n
  FROM sizes, (SELECT unnest(range(0, 61)) AS depth) d GROUP BY ALL
), chosen AS (
  SELECT s.doc_id, s.bytes, min(l.depth) AS depth
  FROM sizes s JOIN levels l ON l.shard = substr(s.hash, 1, l.depth) AND l.total <= {SHARD_BYTES}
  GROUP BY ALL
)
SELECT c.doc_id, c.bytes, c.depth::INTEGER AS depth, l.shard, l.total::BIGINT AS shard_bytes,
       l.n::BIGINT AS shard_rows, true AS fits
FROM chosen c JOIN sizes s USING (doc_id) JOIN levels l ON l.depth = c.depth AND l.shard = substr(s.hash, 1, c.depth)
""",
    "op5_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n
  HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), paths AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN paths l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes n USING (doc_id)
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
""",
    "op8_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM normal WINDOW best AS (PARTITION BY body ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON r.vec_id != a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER best::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 5
""",
    "op12_structure_repair": r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                   lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda crc, b:
      list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM given
), turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM turns
), judged AS (
  SELECT *, left(role, 1) AS first,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), codes AS (
  SELECT conv_id, i, first, fault IN ('blank', 'duplicate') AS forced, (fault = 'truncated')::INTEGER AS cut FROM judged
), ends AS (
  SELECT conv_id, max(i) AS n FROM codes GROUP BY conv_id
), -- cheapest (cost, audit) from a turn on: at the start, after a system turn, after pairs, within a pair
best AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': ''} AS s, {'c': 4, 'a': 'II'} AS d, {'c': 0, 'a': ''} AS p, {'c': 2, 'a': 'I'} AS o
  FROM ends
  UNION ALL
  SELECT conv_id, i, least(bs, {'c': bo.c + 2, 'a': 'I' || bo.a}, {'c': bp.c + 4, 'a': 'II' || bp.a}),
    least(bd, {'c': bo.c + 2, 'a': 'I' || bo.a}, {'c': bp.c + 4, 'a': 'II' || bp.a}),
    least(bp, {'c': bo.c + 2, 'a': 'I' || bo.a}), least(bo, {'c': bp.c + 2, 'a': 'I' || bp.a})
  FROM (
    SELECT c.conv_id, c.i,
      least({'c': s.c + 3, 'a': 'D' || s.a}, CASE WHEN forced THEN never ELSE {'c': o.c + cut + 2, 'a': 'R' || o.a} END,
            CASE WHEN NOT forced AND first = 'u' THEN {'c': o.c + cut, 'a': 'K' || o.a} ELSE never END,
            CASE WHEN NOT forced AND first = 's' THEN {'c': d.c + cut, 'a': 'K' || d.a} ELSE never END) AS bs,
      least({'c': d.c + 3, 'a': 'D' || d.a}, CASE WHEN forced THEN never ELSE {'c': o.c + cut + 2, 'a': 'R' || o.a} END,
            CASE WHEN NOT forced AND first = 'u' THEN {'c': o.c + cut, 'a': 'K' || o.a} ELSE never END) AS bd,
      least({'c': p.c + 3, 'a': 'D' || p.a}, CASE WHEN forced THEN never ELSE {'c': o.c + cut + 2, 'a': 'R' || o.a} END,
            CASE WHEN NOT forced AND first = 'u' THEN {'c': o.c + cut, 'a': 'K' || o.a} ELSE never END) AS bp,
      least({'c': o.c + 3, 'a': 'D' || o.a}, CASE WHEN forced THEN never ELSE {'c': p.c + cut + 2, 'a': 'R' || p.a} END,
            CASE WHEN NOT forced AND first = 'a' THEN {'c': p.c + cut, 'a': 'K' || p.a} ELSE never END) AS bo
    FROM best b JOIN codes c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i - 1,
      (SELECT {'c': 1000000, 'a': ''} AS never)
  )
), chosen AS (
  SELECT conv_id, s.c::BIGINT AS cost, s.a AS audit FROM best WHERE i = 1
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS k FROM chosen WHERE audit <> ''
), edits AS (
  SELECT *, sum((letter <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM letters
), written AS (
  SELECT e.*, j.role, j.text, letter = 'K' AND first = 's' AS opens
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i AND letter <> 'I'
), numbered AS (
  SELECT *, sum((letter <> 'D' AND NOT coalesce(opens, false))::INTEGER) OVER (PARTITION BY conv_id ORDER BY k) AS m FROM written
), said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines
  FROM numbered WHERE letter <> 'D' GROUP BY conv_id
), pairs AS (
  SELECT conv_id, first, lead(first) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM judged
), broken AS (
  SELECT conv_id, count(*) FILTER (NOT ((first, next) IN (('s', 'u'), ('u', 'a'), ('a', 'u')))) AS illegal
  FROM pairs WHERE next IS NOT NULL GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated
  FROM judged GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN broken b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op13_warc": """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
known AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
         min(page_id) OVER (PARTITION BY body) AS first
  FROM bodies
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to
FROM known
""",
}
