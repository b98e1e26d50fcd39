"""Periodic runs of words, by a sparse diagonal dynamic programme that runs along the text.

A lag q has a diagonal: at word p its match length counts the words up to p that equal the word q before them.
Of all earlier occurrences of a word only one can belong to a run, so only that one moves its lag forward: for
periods above B/2 up to B the nearest earlier place where the same B words begin. Within a run of smallest
period q no block of q words or more recurs at less than q words (else the period would be smaller), so that
place lies exactly one period back, and the match length, counted in blocks, is exact. Blocks are numbered by
joining two of half their length where both recur, so a text without repeats ends after a few steps and no
text costs more than n log n. A diagonal that ends with enough matches emits its run at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space; bytes split at exactly space and \\t to \\r."""
    return text.encode("utf-8", "surrogatepass").split()


def nearest_earlier(blocks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks that begin at `at` (rising): places with an earlier equal block, their lag, and which blocks recur."""
    order = np.argsort(blocks, kind="stable")
    same = blocks[order[1:]] == blocks[order[:-1]]
    later, earlier = order[1:][same], order[:-1][same]
    recurs = np.zeros(len(blocks), bool)
    recurs[later] = recurs[earlier] = True
    rank = np.argsort(later)
    return at[later][rank], (at[later] - at[earlier])[rank], recurs


def paired(blocks: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of twice as many words: where a block and the one that follows it both are listed."""
    follower = np.searchsorted(at, at + words)
    follower[follower == len(at)] = 0
    both = at[follower] == at + words
    left, right = blocks[both], blocks[follower[both]]
    _, numbers = np.unique(left * (blocks.max(initial=0) + 1) + right, return_inverse=True)
    return numbers.astype(np.int64), at[both]


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period."""
    n, found, width = len(words), [], 1
    if n < LEAST_WORDS:
        return found
    blocks, at = pd.factorize(np.array(words, object))[0].astype(np.int64), np.arange(n)

    def emit(lag: int, first: int, last: int) -> None:
        length = last + width - (first - lag)
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
            found.append((first - lag, length, lag))

    while True:
        places, lags, recurs = nearest_earlier(blocks, at)
        near = (lags > width // 2) & (lags <= width)
        active: dict[int, list[int]] = {}
        for p, lag in zip(places[near].tolist(), lags[near].tolist()):
            held = active.get(lag)
            if held and held[1] == p - 1:
                held[1] = p
            else:
                if held:
                    emit(lag, *held)
                active[lag] = [p, p]
        for lag, held in active.items():
            emit(lag, *held)
        if width * LEAST_PERIODS >= n or not recurs.any():
            return sorted(found, key=lambda r: (r[0], r[2]))
        blocks, at = paired(blocks[recurs], at[recurs], width)
        width *= 2
        if not len(at):
            return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)] if runs else words


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def runs_of_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, runs (start, length and period in words), strongest (one of them or null), collapsed text.

    A run is a maximal stretch whose smallest period q repeats at least four times, with six words or more. The
    collapsed text has the words outside repeats, joined by one space. A null or empty text, or one of fewer
    than six words, has no run; texts of any length are taken whole, in memory proportional to their words.
    Repeated rows and ids, null ids and extra columns do not matter: each row stands for itself, and only doc_id
    and text are read. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            runs, best, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                held = periodic_runs(words)
                top = strongest(held)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in held])
                best.append(top and dict(zip(("start", "length", "period"), top)))
                texts.append(b" ".join(collapsed(words, held)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, shape), pa.array(best, shape.value_type), pa.array(texts, pa.string())], ["doc_id", "runs", "strongest", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text("text").alias("text")).mapInArrow(run, f"doc_id {kind}, runs {RUNS}, strongest {RUNS[6:-1]}, collapsed string")


def with_periods(words: list, doc_id: int | None) -> list:
    """The words a query works on: in a tenth of the documents, by the digest of the id, they repeat from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


def altered(docs: DataFrame) -> DataFrame:
    """doc_id and text after `with_periods`; a text that stays as it is keeps its white space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                new = with_periods(words, doc_id)
                texts.append(text if new is words else b" ".join(new).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text("text").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def lines_of(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, a tenth of which are made periodic from some word on.

    A null doc_id leaves its text as it is.
    """
    found = runs_of_documents(altered(table(spark, sf_dir, "documents")))
    top = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(F.expr("1000 * strongest.length div strongest.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines_of(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op13_periodic_runs": op13_periodic_runs}
