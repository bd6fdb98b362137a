"""The operators as registered queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsweave.llm import (
    cost_packing,
    exact_dedup,
    importance,
    jaccard,
    kneser_ney,
    language,
    lexical,
    licences,
    lm_score,
    runs,
    tiling,
    token_matrix,
    url_model,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = importance.ImportanceFilter.fit(docs, labels)
    out = model.apply(docs.select("doc_id", "text"))
    return out.select("doc_id", *importance.COUNTS, "base_failed", "kept", "score")


def op1_token_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return token_matrix.pieces(token_matrix.matrices(table(spark, folder, "documents")))


def op2_perplexity_filter(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.filtered(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.judge(table(spark, folder, "pages"))


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.LicenceScanner.fit(docs).scan(docs)


def op7_trie_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_documents(table(spark, folder, "documents"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents")).drop("row_key", "root")


def op9_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(table(spark, folder, "documents"), table(spark, folder, "pages")).drop("row_key")


def op10_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return cost_packing.pack_balanced(table(spark, folder, "documents")).drop("ids")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.document_runs(table(spark, folder, "documents")).drop("runs")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op1_token_matrix": op1_token_matrix,
    "op5_url_filter": op5_url_filter,
    "op6_licence_scan": op6_licence_scan,
    "op7_trie_score": op7_trie_score,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_fusion": op9_language_fusion,
    "op10_cost_packing": op10_cost_packing,
    "op2_perplexity_filter": op2_perplexity_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(a) >= 3 THEN list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]))
    WHEN len(a) > 0 THEN [array_to_string(a, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1"""

SEARCH_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * c.docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, c.docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, c),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)"""

#: The other operators fit models, tokenise or tile, which SQL cannot express; they are tested against brute force.
ORACLES: dict[str, str] = {"op8_jaccard_join": JACCARD_SQL, "op12_lexical_search": SEARCH_SQL, "op13_exact_dedup": DEDUP_SQL}
