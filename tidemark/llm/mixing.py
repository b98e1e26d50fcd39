"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws an exponential key divided by its quality weight; small keys go first. A source's budget
is spent on complete epochs over all its documents and then on a fraction: documents in key order until the
running sum of sizes reaches the rest. The running sum is taken in three levels (256 buckets of 256 buckets
of rows), so that a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, stored, table, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Splits after each word; joined again the parts give the text.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Quality weights lie in [LEAST_WEIGHT, LEAST_WEIGHT + 1]; the least one bounds how many rows a bucket can draw.
LEAST_WEIGHT = 0.5
FANOUT = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 for a text without letters to 1.5 for one of letters only."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(LEAST_WEIGHT) + F.when(F.char_length(text) > 0, letters / F.char_length(text)).otherwise(0.0)


def uniform_draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone, so reruns and retried tasks agree."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Add `target` to one row per source (no_source, source, source_size).

    Weights repeat along the sources by code point, null last. A target stops at `cap` times the source's
    size; the excess is shared again by weight, which ends at one level for all sources below their caps. The
    single window runs over the catalogue of sources, not over documents.
    """
    by_name = Window.orderBy("no_source", "source")
    ranked = sizes.select("*", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"), (F.col("source_size") * cap).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    return levelled.withColumn("level", F.max(fits).over(everything)).select("no_source", "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words taken, repeats counted).

    Needs doc_id, text and source, reads nothing else. `share` is the part of all words to take, weights are
    positive whole numbers. taken = epochs * size, plus the rest of the budget as far as the key order reaches
    the row; the one row at the border is taken in part, so a source's taken words are its target rounded.
    A null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in order;
    rows with the same doc_id share one draw, ties go by doc_id, then size, and equal rows are
    interchangeable. An empty table gives an empty result.
    """
    weight = quality_weight(whole_text("text"))
    draw = uniform_draw(F.col("doc_id"), seed)
    drawn = docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), n_words(whole_text("text")).alias("size"), (-F.log(draw) / weight).alias("order_key")
    )
    position = F.least(F.floor((1.0 - F.exp(-F.col("order_key") * LEAST_WEIGHT)) * (FANOUT * FANOUT)), F.lit(FANOUT * FANOUT - 1)).cast("int")
    rows = stored(drawn.withColumn("bucket", position), "mix")

    source, bucket = ["no_source", "source"], ["no_source", "source", "bucket"]
    fine = rows.groupBy(*bucket).agg(F.sum("size").alias("bucket_size")).withColumn("part", F.floor(F.col("bucket") / FANOUT).cast("int"))
    coarse = fine.groupBy(*source, "part").agg(F.sum("bucket_size").alias("part_size"))
    targets = source_targets(coarse.groupBy(*source).agg(F.sum("part_size").alias("source_size")), weights, share, cap)
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("before_part", F.coalesce(F.sum("part_size").over(earlier(source, "part")), F.lit(0))).join(targets, source)
    fine = fine.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(earlier([*source, "part"], "bucket")), F.lit(0)))
    based = fine.join(coarse, [*source, "part"]).select(*bucket, "source_size", "target", (F.col("before_part") + F.col("before_bucket")).alias("base"))

    inside = Window.partitionBy(*bucket).orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(based, bucket).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.when(some, budget - epochs * F.col("source_size")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its count-th word, white space kept."""
    return F.array_join(F.slice(F.split(text, WORD_END, -1), F.lit(1), count), "")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: a document appears once per complete take, and its first
    words once more where the budget ends inside it. Documents of no words, which cost nothing, stay once.

    Rows are matched on (doc_id, source, size); rows equal in all three are interchangeable and each is
    numbered, so repeated rows keep their own takes. `n_chars`, if there, follows the text.
    """
    taken = mix(docs, **settings)
    size, no, take = (free_name(docs, n) for n in ("_size", "_no", "_take"))
    keyed = docs.withColumn(size, n_words(whole_text("text")))
    same = lambda names, order: F.row_number().over(Window.partitionBy(*names).orderBy(order))
    left = keyed.withColumn(no, same(["doc_id", "source", size], F.xxhash64("text")))
    right = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("taken").alias(take)).withColumn("_n", same(["_d", "_s", "_z"], take))
    both = left.join(right, left["doc_id"].eqNullSafe(right["_d"]) & left["source"].eqNullSafe(right["_s"]) & (left[size] == right["_z"]) & (left[no] == right["_n"]))
    cut = free_name(both, "_cut")
    whole = F.when(F.col(size) > 0, F.floor(F.col(take) / F.col(size))).otherwise(1).cast("int")
    rest = F.when(F.col(size) > 0, F.col(take) % F.col(size)).otherwise(0).cast("int")
    cuts = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    copies = both.withColumn(cut, F.explode(cuts))
    out = copies.withColumn("text", F.when(F.col(cut) > 0, first_words(F.col("text"), F.col(cut))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 1, 2, 3 in turn and share as many words as there are, at most 3 epochs each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op2_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    0.5 + CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / length(text) ELSE 0 END AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS draw
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM ranked WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(level) FILTER (level <= cap::DOUBLE / weight) OVER ()) AS target FROM levels
), spent AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest FROM targets
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.epochs, s.rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.draw) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN spent s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
""",
}
QUERIES = {"op2_source_mixing": op2_source_mixing}
