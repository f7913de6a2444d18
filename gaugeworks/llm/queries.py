"""The text operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import (
    chat_rotation, decontaminate, golay_copies, hard_negatives, language, ngram_join, packing, personal_data, quality_rules, quality_sites,
    spelling, suffix_dedup, token_files,
)
from gaugeworks.llm.common import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM words
), shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN low ON low.a = documents.doc_id
"""


@register("op7_ngram_jaccard_join", JACCARD_SQL)
def op7_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op6_token_orc")
def op6_token_orc(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder)
    return token_files.digests(token_files.read_tokens(spark, folder))


@register("op9_cross_parsing_language")
def op9_cross_parsing_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.language_model(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register("op10_sparse_suffix_array")
def op10_sparse_suffix_array(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


#: All windows of documents that share enough shingles with the items of a length; fingerprints are not needed for the result.
LEAK_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM words WHERE len(w) >= 5
), item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS own
  FROM item_words WHERE len(w) >= 5
), places AS (SELECT item_id, len(own) AS n, unnest(own) AS h, unnest(range(len(own))) AS place FROM items
), numbered AS (SELECT doc_id, unnest(s) AS h, unnest(range(len(s))) AS pos FROM runs
), rich AS (
  SELECT doc_id, n FROM (SELECT DISTINCT doc_id, n, pos FROM numbered JOIN places USING (h))
  GROUP BY doc_id, n HAVING count(*) >= 0.8 * n
), starts AS (
  SELECT doc_id, n, s, unnest(range(0, greatest(len(s) - n, 0) + 1)) AS start FROM rich JOIN runs USING (doc_id)
), windows AS (SELECT doc_id, n, start, s[start + 1:start + n] AS own FROM starts
), window_counts AS (
  SELECT doc_id, n, start, len(own) AS size, h, count(*) AS c
  FROM (SELECT doc_id, n, start, own, unnest(own) AS h FROM windows) GROUP BY ALL
), item_counts AS (SELECT item_id, n, h, count(*) AS c FROM places GROUP BY ALL
), smaller AS (
  SELECT doc_id, item_id, w.n AS n, start, any_value(size) AS size, sum(least(w.c, i.c)) AS m
  FROM window_counts w JOIN item_counts i ON w.n = i.n AND w.h = i.h GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, size, CAST(m AS double) / CAST(size + n - m AS double) AS similarity FROM smaller
)
SELECT doc_id, item_id, max(similarity) AS similarity,
  CAST(arg_min(start, (-similarity, start)) AS bigint) AS first_word, CAST(arg_min(size + 4, (-similarity, start)) AS bigint) AS n_words
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


@register("op8_simhash_decontamination", LEAK_SQL)
def op8_simhash_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("first_word").cast("long"), F.col("n_words").cast("long"))


@register("op4_bootstrapped_pii")
def op4_bootstrapped_pii(spark, sf_dir):
    return personal_data.span_digest(personal_data.personal_spans(table(spark, sf_dir, "documents")))


@register("op1_site_quality")
def op1_site_quality(spark, sf_dir):
    """A document's source is its host; its language's section of the source is the path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_sites.quality_posteriors(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    numbers = ["evidence", "host_quality", "path_quality", "quality"]
    return found.select("doc_id", "host", "path", *[F.round(c, 9).alias(c) for c in numbers], "kept")


ROTATION_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), headed AS (
  SELECT conv_id, perspective, turn, speaker, text, CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10)
    WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM turns JOIN people USING (conv_id)
), placed AS (
  SELECT *, head || text || chr(10) AS rendered, row_number() OVER w - 1 AS position,
    sum(length(head || text || chr(10))) OVER (w ROWS UNBOUNDED PRECEDING) AS e
  FROM headed WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker)
)
SELECT conv_id, perspective, position, turn, speaker, rendered, CAST(e - length(rendered) AS bigint) AS start, CAST(e AS bigint) AS "end",
  CAST(CASE WHEN speaker = perspective THEN e - length(rendered) + length(head) ELSE e END AS bigint) AS loss_start, CAST(e AS bigint) AS loss_end
FROM placed
"""


@register("op2_perspective_rotation", ROTATION_SQL)
def op2_perspective_rotation(spark, sf_dir):
    return chat_rotation.rotations(table(spark, sf_dir, "conversations"))


@register("op3_ngram_quality")
def op3_ngram_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("p_good", F.round("p_good", 9))


@register("op11_golay_simhash")
def op11_golay_simhash(spark, sf_dir):
    found = golay_copies.near_copies(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@register("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.vocabulary(runs, spelling.misspelt(F.col("run"), F.col("doc_id"))))


NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS int) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@register("op13_anchor_tree_negatives", NEGATIVES_SQL)
def op13_anchor_tree_negatives(spark, sf_dir):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
