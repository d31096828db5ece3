"""The queries opN_<name> and pipeline, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.llm import decontam, gru_lm, kdtree, langid, lexical, ngram_join, quality, rlz, sharding, spotsigs, spviterbi, token_store, whiten
from stratal.llm.scratch import new_path

N_SHARDS = 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of a batch that goes to a Python worker; Spark's own bound of 64 MB is held several times over, on both sides of the pipe.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
#: For Python workers: freed memory goes back to the machine, and a worker's arithmetic stays on its own core.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_MMAP_THRESHOLD_": "16777216", "OPENBLAS_NUM_THREADS": "1"}


def find_package(spark: SparkSession) -> None:
    """Python workers started from another folder find this package too, and rows go to them in batches that are small
    beside an executor's memory."""
    spark.conf.set(*BATCH_BYTES)
    for name, value in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), **WORKERS}.items():
        spark.sparkContext.environment.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(langid.part(docs["doc_id"], 5) != 0))
    found = langid.predict(docs, profiles)
    return found.select("doc_id", quality.held_out(found["doc_id"], 5, 0).alias("held_out"), "lang_pred", "score", "nearness")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), 2)
    return token_store.read_tokens(spark, path)


def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt
  FROM t),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3) AS edited FROM o),
x AS (SELECT text FROM e UNION SELECT edited FROM e),
w AS (
  SELECT text, list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda z: z <> '') AS w
  FROM x),
common AS (
  SELECT coalesce(list(word), []::VARCHAR[]) AS common FROM (
    SELECT word FROM (SELECT unnest(list_distinct(w)) AS word FROM t JOIN w USING (text)) GROUP BY word ORDER BY count(*) DESC, word LIMIT %(anchors)d)),
c AS (
  SELECT text, w, list_filter(w, lambda z: NOT list_contains(common, z)) AS c,
         list_filter(list_transform(w, lambda z, i: CASE WHEN list_contains(common, z) THEN i END), lambda i: i IS NOT NULL) AS p
  FROM w, common),
f AS (
  SELECT text, list_sort(list_distinct(list_concat(
    [substr(md5(CASE WHEN len(c) = 0 THEN '^ ' || text WHEN len(c) = 1 THEN '^ ' || c[1] ELSE '^ ' || c[1] || ' ' || c[2] END), 1, 8)],
    CASE WHEN len(p) > 0 THEN list_filter(list_transform(p, lambda q, k: CASE WHEN q - k + 1 < len(c)
      THEN substr(md5(w[q] || ' ' || c[q - k + 1] || ' ' || c[q - k + 2]), 1, 8) END), lambda h: h IS NOT NULL)
    ELSE list_transform(range(2, len(c)), lambda i: substr(md5('* ' || c[i] || ' ' || c[i + 1]), 1, 8)) END))) AS f
  FROM c)
SELECT e.doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(a.f, '-') AS fingerprint, array_to_string(b.f, '-') AS edited_fingerprint,
       len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))) AS near_edited,
       len(list_intersect(a.f, d.f))::DOUBLE / len(list_distinct(list_concat(a.f, d.f))) AS near_next
FROM e JOIN f AS a ON a.text = e.text JOIN f AS b ON b.text = e.edited JOIN f AS d ON d.text = e.nxt
""" % {"anchors": spotsigs.ANCHORS}


def op6_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_copies(table(spark, sf_dir, "documents"), with_text=False)


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
flag AS (SELECT doc_id, s FROM h JOIN (SELECT k, min(doc_id) AS lo FROM h GROUP BY k) USING (k) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS j FROM flag),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
  FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spviterbi.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.describe(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels")
    labels = labels.where(langid.part(labels["doc_id"], 3) != 1).select("doc_id", labels["quality"].alias("label"))
    found = quality.score(stats, quality.fit(stats, labels))
    return found.select("doc_id", quality.held_out(found["doc_id"], 3, 1).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = gru_lm.learn_and_score(docs, langid.part(docs["doc_id"], 10) != 0)
    held_out = quality.held_out(found["doc_id"], 10, 0).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP11_SQL = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
p AS (
  SELECT doc_id, len, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, c.n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * c.n) // c.l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def op12_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.x, b.x) DESC, b.vec_id)::INTEGER AS rank,
       b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY rank <= 5
"""


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"), 4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op5_spotsigs": OP5_SQL, "op6_relative_lz": OP6_SQL, "op11_lexical": OP11_SQL, "op12_kdtree": OP12_SQL}
