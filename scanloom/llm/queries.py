"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import (
    decontaminate,
    jaccard,
    language,
    licenses,
    lines,
    merkle,
    mixing,
    negatives,
    pseudonyms,
    quality,
    token_files,
    tokens,
    vectors,
)

#: The key of the registered query's pseudonyms; a user passes a secret one.
QUERY_KEY = b"scanloom query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced."""
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), QUERY_KEY)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark passages."""
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of each document."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by the similarity of their 3-word shingles."""
    groups = jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already."""
    cut = lines.drop_repeated_lines(_table(spark, sf_dir, "documents"), short=True)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("row.text").alias("text"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of each document."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's token ids stand in compressed files, as read back from them."""
    return token_files.token_digests(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in a Merkle tree by language, and whether a changed copy shows."""
    docs = _table(spark, sf_dir, "documents")
    parts = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = merkle.leaf_of(*parts, F.col("n_chars"), F.col("text"))
    # One more than the largest long has a place too.
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(changed, merkle.leaf_of(*parts, more, F.col("text")))
    carry = F.struct("doc_id", claimed.alias("claimed"))
    rows = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf, carry)
    out = rows.select(
        "carry.doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.path_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("carry.claimed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", changed)
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


#: Windows of 13 words on both sides; shorter items as a whole. Hit words are counted once.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size,
    array_to_string(list_slice(words, k, k + least(13, len(words)) - 1), ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS k
        FROM i WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, k, size, array_to_string(list_slice(words, k, k + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k
        FROM w, sizes WHERE len(words) >= size)
), hits AS (SELECT doc_id, k, dw.size, item_id FROM dw JOIN iw USING (size, phrase)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Overlaps of all pairs that share a shingle, and groups by recursion over the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, k, k + least(3, len(words)) - 1), ' ')
    || '/' || least(3, len(words)) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(3, len(words)) + 2)) AS k
        FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared.n >= 90 * (x.size + y.size - shared.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, size
"""

#: Whole levels as lists; the crc32 bit by bit; a fold over the leaf and its siblings.
OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS id,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents
), c AS (
  SELECT *, sha256(head || chars || body) AS leaf, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(1, len(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
    )) AS crc
  FROM f
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || more || body) ELSE leaf END AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k
  FROM c
), tree AS (
  SELECT lang, 0 AS lv, list(leaf ORDER BY k) AS h FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, lv + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], '')))
  FROM tree WHERE len(h) > 1
), groups AS (
  SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM tree WHERE len(h) = 1
), crown AS (
  SELECT 0 AS lv, list(subroot ORDER BY k) AS h FROM groups
  UNION ALL
  SELECT lv + 1, list_transform(range(0, len(h), 2), lambda i: sha256(h[i + 1] || coalesce(h[i + 2], '')))
  FROM crown WHERE len(h) > 1
), steps AS (
  SELECT l.lang, l.k, lv, l.k >> lv AS j, h FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(h) > 1
  UNION ALL
  SELECT l.lang, l.k, 1000 + lv, g.k >> lv, h
  FROM leaves l JOIN groups g ON l.lang IS NOT DISTINCT FROM g.lang, crown WHERE len(h) > 1
), paths AS (
  SELECT lang, k, list(CASE WHEN j % 2 = 1 THEN 'L' || h[j] ELSE 'R' || coalesce(h[j + 2], '') END ORDER BY lv) AS path
  FROM steps GROUP BY lang, k
), folds AS (
  SELECT l.doc_id, l.leaf, g.subroot, (SELECT h[1] FROM crown WHERE len(h) = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(path, lambda p: p[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(claimed, coalesce(path, [])),
      lambda n, p: CASE WHEN p[1] = 'L' THEN sha256(p[2:] || n) ELSE sha256(n || p[2:]) END) AS folded_root
  FROM leaves l JOIN groups g ON l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.k = p.k
)
SELECT *, folded_root = root AS verified FROM folds
"""

#: All scores of the anchors.
OP13_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language": op2_language,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_vectors": op5_near_vectors,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_licenses": op10_licenses,
    "op11_token_files": op11_token_files,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}
SQL = {"op4_decontaminate": OP4_SQL, "op8_jaccard_join": OP8_SQL, "op12_merkle": OP12_SQL, "op13_negatives": OP13_SQL}
