"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is an anchor (a common word) with the chain of content words that follow it. A fingerprint is
the set of a document's signatures, each as 32 bits. Likeness is the Jaccard similarity of the sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, table, whole_text

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "a all an and are as at be been but by can for from had has have he her his if in is it its no not of on or our she so that the their them then there they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für ich im ist mit nach nicht noch oder sich sie sind so und von war wie wir zu zum zur "
    "al como con del el ella en era es esta fue hay la las lo los más no para pero por que se sin su sus un una y ya".split()
)
CHAIN, SHORT = 2, 3
NO_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD, -1), lambda w: w != "")


def signatures(text: Column, anchors: tuple[str, ...] = tuple(dict.fromkeys(ANCHORS)), chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures of a text.

    Besides the listed words, words of up to three letters are anchors. The start of the text is an anchor too,
    with a chain of full length and one of a single word, so every text has a signature; texts without words
    share theirs.
    With A the places of the anchors and C the content words, the j-th anchor (from 0) at place a has a - j
    content words before it: its chain begins at C[a - j]. A chain at the end of the text is shorter.
    """
    common = lambda w: (F.char_length(w) <= SHORT) | w.isin(*anchors)

    def of(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull())
        content = F.filter(words, lambda w: ~common(w))

        def chained(t: Column) -> Column:
            link = lambda at: [F.get(t["content"], at + k) for k in range(chain)]
            spots = F.transform(t["places"], lambda a, j: F.hash(F.get(words, a), *link(a - j)))
            start = [F.hash(F.lit("^"), *link(F.lit(0))[:n]) for n in dict.fromkeys((1, chain))]
            return F.concat(F.array(*start), spots)

        return let(F.struct(places.alias("places"), content.alias("content")), chained)

    return F.array_sort(F.array_distinct(let(words_of(text), of)))


def printed(signs: Column) -> Column:
    """The set as a string: eight hex digits for each signature, in the order of signed numbers."""
    return F.array_join(F.transform(signs, lambda h: F.lower(F.lpad(F.right(F.hex(h), F.lit(8)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; fingerprints are never empty. Sets that are equal are not intersected."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, 1.0).otherwise(let(common, lambda c: c / (F.size(a) + F.size(b) - c)))


def similar_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of fingerprints with a likeness of the threshold or more, and no others.

    `a` and `b` are the least doc_id of each fingerprint class, a < b; copies are not expanded. A set reaches
    only partners of threshold to 1 / threshold times its length: it goes to the partition of its length and,
    as the shorter side, to the next one, where partitions grow by 1 / threshold. Within a partition it is
    indexed under its rarest signatures only, as many as two sets of that likeness cannot avoid sharing, and
    the exact Jaccard follows. Null texts are empty; rows without doc_id take no part.
    """
    import math

    signed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", signatures(whole_text("text")).alias("signs"))
    classes = stored(signed.groupBy("signs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("signs")), "spots")
    frequency = classes.select(F.explode("signs").alias("sign")).groupBy("sign").count()
    counted = classes.select("id", "n", F.explode("signs").alias("sign")).join(frequency, "sign")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("count", "sign"))
    prefix = counted.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    index = prefix.select("id", "n", "sign", part.alias("part"))
    left = index.select(F.col("id").alias("x"), F.col("n").alias("n_x"), "sign", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    right = index.select(F.col("id").alias("y"), F.col("n").alias("n_y"), "sign", "part")
    fits = (F.col("x") != F.col("y")) & (F.col("n_x") >= threshold * F.col("n_y")) & (F.col("n_y") >= threshold * F.col("n_x"))
    once = (F.col("own") < F.col("part")) | (F.col("x") < F.col("y"))
    pairs = left.join(right, ["sign", "part"]).filter(fits & once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda name: classes.select(F.col("id").alias(name), F.col("signs").alias(f"{name}_signs"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", likeness(F.col("a_signs"), F.col("b_signs")).alias("likeness"))
    return scored.filter(F.col("likeness") >= threshold)


def next_documents(docs: DataFrame) -> DataFrame:
    """Links (doc_id, mark, n, next_id, next_mark) to the next document by doc_id, after the last the first.

    `mark` is a digest of the text; documents order by doc_id (null first), then mark. Rows equal in both are
    one document. The ids are dealt by range, and only the first id of each range meets in one place, so no
    task sees all of them.
    """
    ids = docs.select("doc_id", F.xxhash64(whole_text("text")).alias("mark"), F.char_length(whole_text("text")).cast("long").alias("n")).distinct()
    ranged = stored(ids.repartitionByRange("doc_id", "mark").withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "mark")
    this = F.struct("doc_id", "mark")
    follower = ranged.withColumn("next", F.lead(this).over(inside))
    # One row per range: its first document, and after the last range the first of all.
    order = Window.orderBy("range")
    first = ranged.withColumn("no", F.row_number().over(inside)).filter("no = 1").select("range", this.alias("first"))
    heads = first.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    joined = follower.join(heads, "range").withColumn("next", F.coalesce("next", "head"))
    return joined.select("doc_id", "mark", "n", F.col("next.doc_id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint each text, and it with its last quarter replaced by the start of the next document.

    Null texts are empty; a table of one document is its own next. Repeated rows give equal rows. Whole texts
    are dealt by document once: the same exchange serves each document as itself and as the next of another,
    and only the part that the other needs, with its signatures, moves on.
    """
    no_id = -(2**63)
    key = lambda name: F.coalesce(F.col(name), F.lit(no_id))
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text("text").alias("text"))
    links = next_documents(docs).select(key("doc_id").alias("p_key"), F.col("mark").alias("p_mark"), F.floor(F.col("n") / 4).cast("int").alias("quarter"), key("next_id").alias("key"), F.col("next_mark").alias("mark"))
    dealt = docs.select(key("doc_id").alias("key"), F.xxhash64("text").alias("mark"), "text").repartition("key", "mark")
    once = dealt.withColumn("copy", F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(1)))).filter("copy = 1")
    heads = once.join(links, ["key", "mark"]).select("p_key", "p_mark", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("head"), signatures(F.col("text")).alias("next_signs"))
    heads = heads.withColumnsRenamed({"p_key": "key", "p_mark": "mark"})
    n = F.char_length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int"))
    edited = dealt.join(heads, ["key", "mark"]).select("key", n.cast("long").alias("n_chars"), "text", F.concat(kept, F.col("head")).alias("edited"), "next_signs")
    signed = edited.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("signs"), signatures(F.col("edited")).alias("edited_signs"), "next_signs")
    return signed.select(
        F.when(F.col("key") != no_id, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", printed(F.col("signs")).alias("fingerprint"), printed(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op5_fingerprints": op5_fingerprints}
