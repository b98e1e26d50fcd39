"""Word n-gram Jaccard join: a MinHash LSH forest proposes, exact sets of shingles decide.

A forest has several tries; a document's label in a trie is a string of MinHash values. Documents meet where a
prefix of their labels is the same. The prefix is shortened from the full label until pairs at the threshold
meet in some trie with the target recall, whatever the data. Sorting by trie and prefix brings each meeting
group together; the whole signatures in it rule out pairs that are far from similar, and what remains is kept
as a spanning forest, never as all pairs. Its components are the places of exact verification: documents of a
component come together once, in blocks of bounded size, and their shingle sets are intersected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, groups_of, stored, table, whole_text

N, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 12, 8, 0.999
#: A pair whose signatures agree in fewer places than this is dropped before the exact check: 4.5 standard
#: deviations of the estimate below the threshold.
LEAST_AGREEING = THRESHOLD - 4.5 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5
#: Documents of a meeting group, and of a component, that one task takes against as many others; shingles of these.
MEETING_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 512, 2_000_000
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 2**63, TREES * DEPTH, np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, TREES * DEPTH, np.uint64)


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Longest prefix at which pairs at the threshold meet in some trie with the target recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < target:
        depth -= 1
    return depth


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        return made


def shingles(text: str, memo: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words, case aside; a shorter text is one run; none if empty."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the MinHash under each of the forest's functions, in chunks of bounded memory.

    The low bits: the least of many values has few high bits left to tell sets apart.
    """
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4_096):
        np.minimum(least, (found[None, start : start + 4_096] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=least)
    return (least & np.uint64(0xFFFF)).astype(">u2")


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        keys, sizes, labels = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, memo)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            labels.append(signature(found).tobytes() if len(found) else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary())], ["doc_id", "digest", "key", "n", "label"])


def stars(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """For edges between 0 and n - 1: (center, member) of each connected part, the center its least number."""
    parent = np.arange(n)
    while True:
        before = parent.copy()
        np.minimum.at(parent, a, parent[b])
        np.minimum.at(parent, b, parent[a])
        parent = parent[parent]
        if (parent == before).all():
            break
    return [(int(p), i) for i, p in enumerate(parent) if p != i]


def halves(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the lower and the higher block of a group; the same rows if it is one block."""
    side = group.column("side").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    return np.flatnonzero(side == lo), np.flatnonzero(side == hi)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of pairs whose signatures and sizes allow the threshold, within each meeting group."""
    left, right = [], []
    for group in groups_of(batches, ["tree", "prefix", "lo", "hi"]):
        keys = group.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        group, keys = group.take(pa.array(order)), [keys[i] for i in order]
        sizes = group.column("n").to_numpy().astype(np.float64)
        labels = np.frombuffer(b"".join(group.column("label").to_pylist()), np.uint16).reshape(len(keys), -1)
        low, high = halves(group)
        ends = ([], [])
        step = max(1, 2_000_000 // max(len(high), 1) // 8)
        for start in range(0, len(low), step):
            rows = low[start : start + step]
            agreeing = np.zeros((len(rows), len(high)), np.int16)
            for c in range(labels.shape[1]):
                agreeing += labels[rows, c][:, None] == labels[high, c][None, :]
            close = agreeing >= LEAST_AGREEING * labels.shape[1]
            close &= np.minimum(sizes[rows][:, None], sizes[high][None, :]) >= THRESHOLD * np.maximum(sizes[rows][:, None], sizes[high][None, :]) - 1e-9
            i, j = np.nonzero(close)
            ends[0].append(rows[i])
            ends[1].append(high[j])
        for c, m in stars(np.concatenate(ends[0]), np.concatenate(ends[1]), len(keys)) if ends[0] else ():
            left.append(keys[c])
            right.append(keys[m])
        if len(left) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard within a component, or between two blocks of one.

    Returns (a, b, links): for each key a the number of documents it is linked to here (b null), and spanning
    edges a, b of the links (links null). Shingles are numbered and counted by products of 0/1 matrices over
    slices of the numbering; shingles of one document cannot be shared and are left out.
    """
    for group in groups_of(batches, ["component", "lo", "hi"]):
        keys = group.column("key").to_pylist()
        once = {key: i for i, key in enumerate(keys)}
        order = [once[key] for key in sorted(once)]
        group, keys = group.take(pa.array(order)), sorted(once)
        copies = group.column("copies").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        owner, number = owner[shared[number]], place[number[shared[number]]]
        by_number = np.argsort(number, kind="stable")
        owner, number = owner[by_number], number[by_number]
        low, high = halves(group)
        common = np.zeros((len(low), len(high)), np.float32)
        width = 4_096
        for start in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(number, [start, start + width])
            ones = np.zeros((len(sets), width), np.float32)
            ones[owner[a:b], number[a:b] - start] = 1.0
            common += ones[low] @ ones[high].T
        union = sizes[low][:, None] + sizes[high][None, :] - common
        linked = common >= THRESHOLD * union - 1e-6
        within = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        if within:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(keys), np.int64)
        links[low] += linked @ copies[high]
        if not within:
            links[high] += linked.T @ copies[low]
        i, j = np.nonzero(linked)
        edges = stars(low[i], high[j], len(keys))
        some = np.flatnonzero(links)
        left = [keys[x] for x in some] + [keys[c] for c, _ in edges]
        right = [None] * len(some) + [keys[m] for _, m in edges]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array([int(links[x]) for x in some] + [None] * len(edges), pa.int64())], ["a", "b", "links"])


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the least key of each connected part, for keys with an edge.

    Alternates the large-star and small-star steps until no edge changes; the number of rounds grows with the
    logarithm of the longest path. Each round is written, so a lost executor costs one round at most.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        joined = both.join(least, both["a"] == least["node"])
        if large:
            return joined.filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        inner = joined.filter(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b")
        return inner.unionByName(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).filter("a != b").distinct()

    def seen(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    held = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = seen(held)
    while known[0]:
        held = stored(star(star(held, True), False), "edges")
        now = seen(held)
        if now == known:
            break
        known = now
    return held.select(F.col("b").alias("key"), F.col("a").alias("component")).unionByName(held.select(F.col("a").alias("key"), F.col("a").alias("component")).distinct())


def paired_blocks(frame: DataFrame, blocks: Column) -> DataFrame:
    """Add lo, hi, side: rows of a group are dealt to blocks by a digest of the key, and each block goes to the
    pair it forms with every block of its group, itself included."""
    blocks = F.ceil(blocks).cast("int")
    dealt = frame.withColumn("side", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other")).drop("_other")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, key, n) of docs, and for each key with words (k, component, c, l): see jaccard_join.

    A node's text is fetched back by doc_id and digest of the text together, so rows that share a doc_id, or have
    none, meet only the nodes of their own text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text("text").alias("text")).withColumn("digest", digest_of(F.col("text")))
    rows = stored(texts.mapInArrow(signed, f"doc_id {kind}, digest binary, key binary, n int, label binary"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    nodes = rows.filter("n > 0").groupBy("key").agg(first.alias("row"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("label").alias("label"))
    nodes = stored(nodes.select("key", F.col("row.doc_id").alias("rep"), F.col("row.digest").alias("mark"), "copies", "n", "label"), "nodes")

    width, used = 2 * DEPTH, 2 * prefix_depth()
    prefixes = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(F.col("label"), 1 + width * t, used).alias("prefix")) for t in range(TREES)])
    entries = nodes.select("key", F.inline(prefixes))
    groups = entries.groupBy("tree", "prefix").agg(F.count("*").alias("members")).filter("members > 1")
    met = paired_blocks(entries.join(groups, ["tree", "prefix"]), F.col("members") / MEETING_ROWS).select("tree", "prefix", "lo", "hi", "side", "key")
    met = met.join(nodes.select("key", "n", "label"), "key")
    dealt = met.repartition("tree", "prefix", "lo", "hi").sortWithinPartitions("tree", "prefix", "lo", "hi")
    candidates = components(dealt.mapInArrow(meetings, "a binary, b binary"))

    known = candidates.join(nodes.select("key", "rep", "mark", "copies", "n"), "key")
    sized = known.groupBy("component").agg(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    wanted = known.join(sized, "component").drop("n")
    met = texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["digest"] == wanted["mark"])
    fetched = texts.join(wanted, met).select("text", "component", "blocks", "copies", "key")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        for batch in batches:
            keep, sets = [], []
            for i, (text, key) in enumerate(zip(batch.column("text").to_pylist(), batch.column("key").to_pylist())):
                if key not in seen:  # repeated rows have one doc_id and text
                    seen.add(key)
                    keep.append(i)
                    sets.append(shingles(text, memo).tobytes())
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in ("component", "blocks", "copies", "key")], pa.array(sets, pa.binary())], ["component", "blocks", "copies", "key", "shingles"])

    sets = fetched.mapInArrow(shingled, "component binary, blocks double, copies long, key binary, shingles binary")
    placed = paired_blocks(sets, F.col("blocks")).select("component", "lo", "hi", "side", "key", "copies", "shingles")
    checked = stored(placed.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(verified, "a binary, b binary, links long"), "links")

    links = checked.filter("links IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = components(checked.filter("b IS NOT NULL").select("a", "b"))
    named = classes.join(nodes.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("class_id"))
    summary = nodes.select("key", "copies", "rep").join(links, "key", "left").join(classes.join(named, "component").select("key", "component", "class_id"), "key", "left")
    told = summary.select(F.col("key").alias("k"), F.coalesce("component", "key").alias("component"), F.coalesce("class_id", "rep").alias("c"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("l"))
    return rows, told


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links.

    n_links counts the other rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
    copies included; class_id is the least doc_id of the rows joined by such links. Needs doc_id and text and
    reads nothing else. Texts of equal shingles are one node with its copies; a text of fewer than five words
    is one shingle; texts without a word link to nothing, their class is their own doc_id. Very long texts are
    taken whole and bound the blocks they are compared in by their shingles. Rows with a null
    doc_id take part; a class without any doc_id has a null class_id. Repeated rows are copies of each other.

    Links are exact; a pair at exactly 0.8 is met with the target recall of 0.999, more similar ones more surely.
    """
    rows, told = linked(docs)
    joined = rows.join(told.drop("component"), rows["key"] == told["k"], "left")
    return joined.select("doc_id", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("l", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies; the columns of docs.

    Of a class the row with the least doc_id stays (rows without one come last), of several the one with the
    least digest of the text: rows that share a doc_id, or have none, are judged by their texts. Rows without a
    word stay, repeated rows of one doc_id and text once.
    """
    rows, told = linked(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    least = rows.filter("n > 0").groupBy("key").agg(F.min(order).alias("row"))
    chosen = least.join(told, least["key"] == told["k"]).groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.digest", F.lit(False).alias("all"))
    wordless = rows.filter("n = 0").select("doc_id", "digest", F.col("doc_id").isNull().alias("all")).distinct()
    kept = chosen.unionByName(wordless).toDF("_kept", "_digest", "_all")
    own, no = free_name(docs, "_own"), free_name(docs, "_no")
    marked = docs.withColumn(own, digest_of(whole_text("text")))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_kept"]) & (marked[own] == kept["_digest"]))
    first = Window.partitionBy("doc_id", own).orderBy(own)
    one = found.filter(~kept["_all"]).withColumn(no, F.row_number().over(first)).filter(F.col(no) == 1)
    return one.select(*[marked[c] for c in docs.columns]).unionByName(found.filter(kept["_all"]).select(*[marked[c] for c in docs.columns]))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
