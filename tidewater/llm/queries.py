"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, langid, mixing, ngram_join, packing, pii, quality, token_store, toxicity, warc
from tidewater.plans.scratch import durable, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = durable(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    mixed = mixing.with_copies(sized, mixing.plan_mix(sized))
    return mixed.select("doc_id", "size", "__tw_mix.source_size", "__tw_mix.target", (F.col("size") * F.col("__tw_mix.copies")).alias("taken"), "__tw_mix.rate", "__tw_mix.copies")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), store, vocabulary("word_bpe_49k.json"), "dropped", 1)
    return token_store.read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.train(docs))
    place = "array_position(array({}), x.kind)".format(", ".join(f"'{k}'" for k in pii.ALL_KINDS))
    listed = "array_join(transform(array_sort(transform({}, x -> struct(" + place + " AS k, x.start AS a, x.end AS b, x.kind AS kind))), x -> concat(x.kind, ':', x.a, ':', x.b)), ',')"
    text = lambda spans: F.expr(listed.format(spans))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    added = F.size("added").cast("long").alias("n_added")
    total = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("concat(base, added)").alias("spans"), added, total)


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    names = warc.write_archives(warc.decided(_table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder, names).drop("payload")


def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "kept", 0, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: White space of the contracts, as a class of DuckDB's regular expressions.
_S = r"\x20\x09-\x0D"

_OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_S}]+')) AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals
), capped AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS budget FROM weighted
), steps AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS before, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM capped WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min((budget - before) / open_weight, cap / weight) AS level FROM steps WHERE cap / weight >= (budget - before) / open_weight
), planned AS (
  SELECT source, source_size, CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS target FROM capped, water
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM planned
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
), mixed AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target, (size * copies)::BIGINT AS taken, rate::DOUBLE AS rate, copies::BIGINT AS copies FROM mixed
"""

_OP3_SQL = rf"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[{_S}]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM norm
"""


_OP4_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_S}]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), tokens AS (
  SELECT doc_id, unnest(s) AS t, len(s) AS n FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 75 * (n + m - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, label) AS (
  SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.label FROM reach JOIN both_ways ON reach.id = both_ways.a
), labels AS (
  SELECT id, min(label) AS label FROM reach GROUP BY id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id FROM sets LEFT JOIN labels ON id = doc_id
"""

_OP8_SQL = """
WITH own AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), hashed AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM own
), won AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS winner FROM hashed
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    (((('0x' || substr(h || '0', (5 * i) // 4 + 1, 2))::INTEGER >> (3 - (5 * i) % 4)) & 31))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM won
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1_SQL, "op3_exact_dedup": _OP3_SQL, "op4_ngram_jaccard": _OP4_SQL, "op8_warc_segments": _OP8_SQL}
