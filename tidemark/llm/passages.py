"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed and the hashes are joined over all documents. The first
document (by doc_id) that holds a run keeps it; a sentence covered by a run that is not the first goes. The
text passes through Python as a stream; grouping and joining of hashes is Spark's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import free_name, table, whole_text

RUN = 3
#: However long its sentences are, a run has several: one shared sentence alone is no passage.
LEAST_SENTENCES = 2
LEAST_CHARS = 40
#: A sentence counts once, and once more for every so many characters: a passage may have few but long ones.
LONG_CHARS = 60
#: The sentences and lines of a text, each with its ends and the white space behind it; together they are the text.
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")


def runs_of(text: str, run: int = RUN, least: int = LEAST_CHARS, long: int = LONG_CHARS) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The sentences, and (hash, first, last + 1) of each run, by place.

    A run starts at every sentence with a word and takes at least `run` of them and `least` characters; a
    sentence counts once more for every `long` characters, but a run never has less than two. It may end early
    only if it is the whole text.
    Case and white space do not count. Lines are sentences; where a single newline ends one without a full stop,
    runs are taken once more with such lines joined, so it does not matter where a paragraph is wrapped.
    """
    parts = SENTENCE.findall(text)
    lines: list[tuple[str, int, int]] = []
    joined: list[tuple[list[str], int, int]] = []
    wraps = False
    for i, part in enumerate(parts):
        words = part.lower().split()
        if words:
            line = " ".join(words)
            lines.append((line, i, i + 1))
            if wraps:
                joined[-1][0].append(line)
                joined[-1] = (*joined[-1][:2], i + 1)
            else:
                joined.append(([line], i, i + 1))
        bare = part.rstrip()
        wraps = bool(joined) and (bool(words) or wraps) and not bare.endswith((".", "!", "?")) and part.count("\n", len(bare)) == 1
    runs = runs_over(lines, len(parts), run, least, long)
    if len(joined) < len(lines):
        more = runs_over([(" ".join(found), first, end) for found, first, end in joined], len(parts), run, least, long)
        runs = sorted({*runs, *more}, key=lambda r: (r[1], r[2], r[0]))
    return parts, runs


def runs_over(sentences: list[tuple[str, int, int]], size: int, run: int, least: int, long: int) -> list[tuple[int, int, int]]:
    runs, n = [], len(sentences)
    plain = [sentence for sentence, *_ in sentences]
    for i in range(n):
        j, width, count = i, 0, 0
        while j < n and (count < run or width < least or j - i < LEAST_SENTENCES):
            width += len(plain[j])
            count += 1 + len(plain[j]) // long
            j += 1
        if count < run or width < least or j - i < LEAST_SENTENCES:
            if i == 0:
                runs.append((hashed(plain), 0, size))
            break
        runs.append((hashed(plain[i:j]), sentences[i][1], sentences[j - 1][2]))
    return runs


def hashed(sentences: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sentences).encode("utf-8")) - (1 << 63)


def uncovered(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without the sentences covered by a run in `gone` or by a repeat within the text; how many."""
    parts, runs = runs_of(text)
    seen: set[int] = set()
    covered = bytearray(len(parts))
    for h, first, end in runs:
        if h in gone or h in seen:
            covered[first:end] = b"\x01" * (end - first)
        seen.add(h)
    n = sum(covered)
    return ("".join([p for p, c in zip(parts, covered) if not c]) if n else text), n


def document_key(column: str) -> Column:
    """A null doc_id comes before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def deduplicated(docs: DataFrame, removed: str = "n_removed") -> DataFrame:
    """docs with repeated passages cut from `text`, plus the number of removed sentences.

    Needs a whole-number doc_id and text; other columns pass through, `n_chars`, if there, follows the text, a
    column named like `removed` is replaced. Rows of one doc_id, or of none, count as one document: a passage
    is not taken from one of them because another has it. A null text stays null, an empty one empty; a later
    copy of a whole document keeps an empty text. The result does not depend on the order of rows.
    """
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = {h for h, _, _ in runs_of(text)[1]}
                keys += [key] * len(found)
                hashes += found
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["key", "hash"])
                    keys, hashes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["key", "hash"])

    texts = docs.select(document_key("doc_id").alias("key"), whole_text("text").alias("text")).filter(F.col("text") != "")
    held = texts.mapInArrow(spans, "key long, hash long")
    # Which runs are in several documents, and the first document of each: partial sums meet hot runs.
    first = held.groupBy("hash").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("hash", "first")
    later = held.join(first, "hash").filter(F.col("key") > F.col("first"))
    key, gone = free_name(docs, "_key"), free_name(docs, "_gone")
    marks = later.groupBy(F.col("key").alias(key)).agg(F.collect_set("hash").alias(gone))
    keyed = docs.withColumn(key, document_key("doc_id")).join(marks, key, "left")
    kept = [f for f in docs.schema.fields if f.name.lower() != removed.lower()]
    out = StructType([StructField("text", StringType()) if f.name == "text" else f for f in kept] + [StructField(removed, LongType())])
    follows = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, widths = [], [], []
            for text, hashes in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist()):
                t, n = uncovered(text, set(hashes or ())) if text else (text, 0)
                texts.append(t)
                counts.append(n)
                widths.append(len(t or ""))
            new = {"text": pa.array(texts, pa.string()), removed: pa.array(counts, pa.int64())}
            if follows:
                old = batch.column("n_chars")
                new["n_chars"] = pa.array([w if n else o for w, n, o in zip(widths, counts, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in out.fields], [f.name for f in out.fields])

    return keyed.select(*[f.name for f in kept], gone).mapInArrow(cut, out)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages an earlier document holds, and how many sentences went."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


SQL: dict[str, str] = {}
QUERIES = {"op10_passage_dedup": op10_passage_dedup}
