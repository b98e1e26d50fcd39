"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax over the two
classes follows. The fit uses a bounded sample of labelled documents. As everything after the average is
linear before the softmax, scoring needs one number per hash bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import free_name, table, whole_text

BUCKETS = 1 << 16
NGRAMS = (2, 3, 4)
DIMENSION = 10
EPOCHS = 8
RATE = 0.5
#: At most about so many labelled documents are used for the fit.
TRAINING_ROWS = 6_000
THRESHOLD = 0.3


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8")) % BUCKETS
        return made


def features(text: str, memo: WordBuckets) -> np.ndarray:
    """Buckets of all words and all byte n-grams, white space as one space, in half each."""
    words = text.split()
    if len(memo) > 200_000:
        memo.clear()
    found = [np.fromiter(map(memo.__getitem__, words), np.int32, len(words))]
    data = np.frombuffer(f" {' '.join(words)} ".encode("utf-8"), np.uint8).astype(np.uint32)
    for n in NGRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h + data[k : len(data) - n + 1 + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(found)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> np.ndarray:
    """Bucket logits, and the bias as a last entry, from (buckets, shares, label) rows; shares sum to 1.

    Vectors E and output weights W of two classes descend on the softmax loss, one document at a time, the
    rate falling to zero. Classes weigh equally in the loss; the bias then returns to the observed balance.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    output, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    labels = np.array([r[2] for r in rows])
    if not len(rows) or labels.min() == labels.max():
        constant = 0.0 if not len(rows) else (4.0 if labels[0] else -4.0)
        return np.append(np.zeros(BUCKETS), constant).astype(np.float32)
    weight = len(rows) / (2.0 * np.bincount(labels, minlength=2))
    total, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, shares, label = rows[i]
            rate = RATE * (1.0 - done / total) * weight[label]
            done += 1
            hidden = shares @ vectors[buckets]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = p
            error[label] -= 1.0
            back = output.T @ error
            output -= rate * np.outer(error, hidden)
            bias -= rate * error
            # A share of 1/n per feature makes tiny steps; the factor keeps vectors and output at one pace.
            vectors[buckets] -= (rate * 20.0) * shares[:, None] * back[None, :]
    line = output[1] - output[0]
    return np.append(vectors @ line, bias[1] - bias[0] + np.log(weight[0] / weight[1])).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> np.ndarray:
    """Fit on a sample of about `rows` labelled documents, drawn by a digest of doc_id.

    Rows without a label, doc_id or text match take no part. Two labels of one document: the larger counts;
    two texts of one doc_id: both are examples. The fit is one task over the bounded sample; only the logits
    (256 kB) come to the driver. Without labels every score is 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    total = max(known.count(), 1)
    share = min(1.0, rows / total)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    # The sample has about `rows` small rows whatever the tables hold: a proven bound for a broadcast.
    sample = docs.select("doc_id", whole_text("text").alias("text")).join(F.broadcast(drawn.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordBuckets()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                buckets, counts = np.unique(features(text, memo), return_counts=True)
                out.append((buckets.tobytes(), (counts / max(counts.sum(), 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column("label").cast(pa.int32())], ["doc_id", "buckets", "shares", "label"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            held += zip(*cols)
        held.sort()
        model = fit([(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32), y) for _, b, s, y in held])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    prepared = sample.select("doc_id", "text", "label").mapInArrow(featured, "doc_id string, buckets binary, shares binary, label int")
    got = prepared.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def score(docs: DataFrame, model: np.ndarray, name: str = "score") -> DataFrame:
    """docs plus the probability of label 1 of each whole text; nulls and empty texts get a score too."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, logits = WordBuckets(), held.value
        for batch in batches:
            z = np.array([logits[f].mean() if len(f := features(t or "", memo)) else 0.0 for t in batch.column("text").to_pylist()], np.float64) + float(logits[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-z)), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, kinds)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id")))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, unchanged, whose text scores at least the threshold."""
    name = free_name(docs, "score")
    return score(docs, train(docs, training_labels(labels)), name).filter(F.col(name) >= threshold).select(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; labels are learnt from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, training_labels(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op6_quality_classifier": op6_quality_classifier}
