"""SpotSigs document fingerprints, in DataFrame operations only.

A spot signature is an anchor (one of the words that most documents of the corpus contain) with
the CHAIN content words that follow it, anchors skipped; the start of a text is an anchor too, so that
every text has a signature, and in a text without anchors every word is one. The fingerprint is the
sorted set of the signatures' hashes as one string, and the likeness of two fingerprints the Jaccard of the sets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Words that serve as anchors.
ANCHORS = 64
CHAIN = 2
#: A bucket of the doc_id order holds about so many rows, more if there would be over MAX_BUCKETS; the driver gets a number of each.
BUCKET_ROWS = 2048
MAX_BUCKETS = 1 << 15

_WORDS = r"filter(split(lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ')), ' '), x -> x <> '')"
# transform(array(x), v -> ...)[0] binds x to v, so that it is evaluated once
_SPOTS = f"""
transform(array(named_struct('w', {_WORDS})), s ->
 transform(array(named_struct('w', s.w,
   'c', filter(s.w, x -> NOT x IN ({{common}})),
   'p', filter(transform(s.w, (x, i) -> IF(x IN ({{common}}), i, NULL)), i -> i IS NOT NULL))), v ->
  array_join(sort_array(array_distinct(concat(
   array(substr(md5(CASE WHEN size(v.c) = 0 THEN concat('^ ', {{t}}) WHEN size(v.c) = 1 THEN concat('^ ', v.c[0])
                         ELSE concat_ws(' ', '^', v.c[0], v.c[1]) END), 1, 8)),
   CASE WHEN size(v.p) > 0 THEN
     filter(transform(v.p, (q, k) -> IF(q - k + 1 < size(v.c),
       substr(md5(concat_ws(' ', v.w[q], v.c[q - k], v.c[q - k + 1])), 1, 8), NULL)), h -> h IS NOT NULL)
    WHEN size(v.c) > 2 THEN transform(sequence(1, size(v.c) - 2), i -> substr(md5(concat_ws(' ', '*', v.c[i], v.c[i + 1])), 1, 8))
    ELSE CAST(array() AS array<string>) END))), '-'))[0])[0]
"""


def common_words(text: DataFrame, n: int = ANCHORS) -> list[str]:
    """The ``n`` words that most rows of ``text`` (a string column of that name, no nulls) contain; the lesser word first among equals."""
    words = text.select(F.explode(F.array_distinct(F.expr(_WORDS.format(t="text")))).alias("word"))
    return [r["word"] for r in words.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(n).collect()]


def fingerprint(text: str, anchors: list[str]) -> Column:
    """Of the string column named ``text`` (no nulls). The k-th anchor stands before content word place - k."""
    # words are letters and digits, so they need no quoting
    return F.expr(_SPOTS.format(t=text, common=", ".join(f"'{w}'" for w in anchors) or "NULL").replace("x IN (NULL)", "false"))


def likeness(one: Column, two: Column) -> Column:
    """Jaccard of two fingerprints, 0 to 1."""
    a, b = F.split(one, "-"), F.split(two, "-")
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def _bucket(doc_id: str, cuts: list[int]) -> Column:
    """How many of the rising ``cuts`` lie below: a binary search over a constant array. Null: 0."""
    if not cuts:
        return F.lit(0)
    array = f"from_json('{json.dumps(cuts)}', 'array<bigint>')"
    steps = ", ".join(str(1 << i) for i in reversed(range(len(cuts).bit_length())))
    return F.expr(f"aggregate(array({steps}), 0, (p, s) -> IF(p + s <= {len(cuts)} AND element_at({array}, IF(p + s <= {len(cuts)}, p + s, 1)) < {doc_id}, p + s, p))")


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS, made: dict[str, Column] | None = None) -> DataFrame:
    """``rows``, with the columns ``made``, with next_<c> of the row that follows in descending doc_id (nulls last, equal ids in
    order of ``mark``); the first row follows the last.

    Rows are dealt to ranges of doc_id; each range also gets a ghost of the row after its last,
    so that neighbours stand in one range and rows are shuffled once. What is ``made`` is made after the ghosts are chosen,
    so that no row pays for it to be looked through for them.
    """
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    cuts: list[int] = []
    if parts > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
        cuts = sorted(set(found or []))
    rows = rows.withColumn("bucket", _bucket("doc_id", cuts))
    heads = sorted(((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    ghosts = [{"bucket": b, "head": heads[(i + 1) % len(heads)][1]} for i, (b, _) in enumerate(heads)]
    target = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ghosts)), "array<struct<bucket:int,head:bigint>>")))
    target = F.broadcast(target.withColumnRenamed("bucket", "target"))
    extra = rows.join(target, rows["doc_id"].eqNullSafe(target["head"])).withColumn("bucket", F.col("target")).drop("target", "head")
    rows, extra = (x.withColumns(made or {}) for x in (rows, extra))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(extra.withColumn("ghost", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "mark")
    out = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return out.where("ghost = 0").drop("ghost", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the first floor(n_chars / 3) signs of the next document's instead
    of as many of its own. Anchors are the words that most texts contain. Null texts are empty; a single row is its own next. Only doc_id and
    text are read. Many rows of one doc_id would stand in one range: doc_id is taken for a key.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    anchors = common_words(rows)
    near = with_next(rows.withColumn("mark", F.xxhash64("text")), ["text", "fingerprint"], made={"fingerprint": fingerprint("text", anchors)})
    cut = near.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars DIV 3 AS INT)), substring(next_text, 1, CAST(n_chars DIV 3 AS INT)))")
    )
    both = cut.withColumn("edited_fingerprint", fingerprint("edited", anchors))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, fingerprint; pairs: one, two, likeness of distinct fingerprints alike enough).

    Null texts count as empty; rows without a doc_id are members too; equal texts share a fingerprint, so copies make no pairs.

    Sets are partitioned by length, in steps of 1 / threshold, so that a set meets those of its
    own and the next partition only. Two sets meet if they share one of their rarest
    n - ceil(threshold * n) + 1 signatures; lengths are compared before the sets are.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    members = rows.select("doc_id", fingerprint("text", common_words(rows)).alias("fingerprint"))
    sets = members.select("fingerprint").distinct().withColumn("spots", F.split("fingerprint", "-")).withColumn("n", F.size("spots"))
    sets = sets.withColumn("id", F.xxhash64("fingerprint")).withColumn("step", F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))))
    spots = sets.select("id", "n", "step", F.explode("spots").alias("spot"))
    counts = spots.groupBy("spot").agg(F.count("*").alias("c"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("c", "spot"))
    short = spots.join(counts, "spot").withColumn("rank", order).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    short = short.where("c > 1").select("id", "n", "step", "spot")
    a = short.select("spot", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    b = short.select("spot", F.col("id").alias("b"), F.col("n").alias("nb"), "step")
    met = a.join(b, ["spot", "step"]).where("a <> b AND (na < nb OR (na = nb AND a < b))").where(F.col("na") >= F.lit(threshold) * F.col("nb"))
    met = met.select("a", "b").distinct()
    one, two = (sets.select(F.col("id").alias(i), F.col("fingerprint").alias(c)) for i, c in (("a", "one"), ("b", "two")))
    pairs = met.join(one, "a").join(two, "b").select("one", "two", likeness(F.col("one"), F.col("two")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)
