"""The dealt operators over their whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm import centroid_search, decontamination, filter_audit, html_text, language_id, line_dedup, lm_scoring, packing, quality_model, quality_rules, sharding, simhash, substring_dedup
from usageloom.llm.staging import Stage
from usageloom.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
#: The vocabulary that packing counts tokens with.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


#: Rows and bytes that a Python worker is handed at once.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def reachable(spark: SparkSession) -> None:
    """Set a session up for Python workers: small batches, and this package on their path.

    Shuffle files go when the query that wrote them ends: staged tables carry the
    rows from one query of a job to the next.

    On a cluster without the driver's folder the package is sent with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, root) if p)


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, by a stored slot map.

    The first version of the map deals all slots to 39 shards. Then a shard is
    added: the second version is the stored first one with some slots moved, and
    the documents lie where it says. ``first_shard`` is their shard before.
    """
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    records = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + sharding.RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    staged = Stage(spark, "sharding").keep(records.withColumn("virtual_slot", sharding.slot_of(keys)))
    totals = sharding.slot_totals(staged)
    path = scratch_dir(spark, "slot-map")
    sharding.save_map(spark, path, 1, sharding.first_map(totals, SHARDS - 1))
    first = sharding.load_map(spark, path, 1)
    sharding.edit_map(spark, path, 1, totals, SHARDS)
    placed = sharding.place(staged, sharding.load_map(spark, path, 2), keys)
    before = F.broadcast(first.withColumnRenamed("shard", "first_shard"))
    return placed.join(before, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "first_shard",
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    placed = packing.pack_documents(documents(spark, sf_dir), VOCABULARY)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose cutoffs falsely reject few good documents of each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("stratum"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = quality_rules.judge(docs, labels)
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def fold(column: str, of: int) -> Column:
    """crc32(doc_id as text) modulo a number: the folds that models are tested on."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    model = language_id.fit_on(docs.where(~held_out))
    scored = language_id.with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from three quarters of the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit_on(docs, labels.where(fold("doc_id", 4) != 2))
    scored = quality_model.with_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from four fifths of them."""
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 5) == 1)
    return lm_scoring.score_texts(docs)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items: one row per document and item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked = decontamination.with_leaks(documents(spark, sf_dir), benchmark)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated line runs."""
    docs = documents(spark, sf_dir)
    kept = line_dedup.without_repeats(docs)
    return kept.select(
        "doc_id",
        F.size("removed_lines").alias("n_removed_lines"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        "removed_lines",
    )


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier."""
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in every order over all documents of each source, with exact Shapley values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit.audit(docs, labels, F.col("source"))


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters, after five exact rounds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroid_search.cluster(vectors)


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    texts = html_text.with_main_text(pages)
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLES["op11_filter_audit"] = r"""
WITH words AS (
  SELECT COALESCE(doc_id, -9223372036854775808) AS d, doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS body,
         list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
docs AS (
  SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
           WHEN 'A' THEN len(ws) < 200
           WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws)
           WHEN 'C' THEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body)
           WHEN 'D' THEN regexp_matches(body, '[#$%&*|]')
           ELSE d > first_d END) AS fails
  FROM (SELECT *, min(d) OVER (PARTITION BY body) AS first_d FROM words) AS w LEFT JOIN marks USING (doc_id)
),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
counted AS (
  SELECT part, filter_order, step, f AS filter,
         CAST(sum(n) FILTER (NOT list_has_any(fails, list_append(earlier, f))) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, earlier)) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (fails = [f]) AS BIGINT) AS unique_fails,
         CAST(sum(n * good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS good_lost,
         CAST(sum(n * toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, earlier)) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, filter, COALESCE(kept, 0) AS kept, COALESCE(removed, 0) AS removed,
       COALESCE(redundant, 0) AS redundant, COALESCE(unique_fails, 0) AS unique_fails,
       COALESCE(good_lost, 0) AS good_lost, COALESCE(toxic_lost, 0) AS toxic_lost,
       CAST(sum(COALESCE(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""


def _rounds(rounds: int) -> str:
    """Assign and move, as often as asked, then assign once more."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT id, vec_id, v, best.c AS c, best.d AS d FROM (
    SELECT id, vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS best
    FROM kept, centroids{r} GROUP BY id, vec_id, v)
)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM near{r}) GROUP BY c, i
),
means{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM sums{r} GROUP BY c),
centroids{r + 1} AS (SELECT c, COALESCE(n.m, o.m) AS m FROM centroids{r} o LEFT JOIN means{r} n USING (c))""")
    return ",".join(steps)


ORACLES["op12_centroid_clustering"] = f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT sha256('2:' || COALESCE(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 40)
),{_rounds(centroid_search.ROUNDS)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near{centroid_search.ROUNDS} JOIN centroids{centroid_search.ROUNDS} USING (c)
"""
