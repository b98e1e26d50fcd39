"""Tables with the awkward rows every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words):
    rng = random.Random(seed)
    stems = ["river", "stone", "the", "of", "and", "cold", "light", "in", "market", "runs", "a", "under", "old", "bridge", "with", "gold", "to", "north"]
    out = []
    for i in range(words):
        out.append(rng.choice(stems) + (str(rng.randrange(40)) if rng.random() < 0.4 else ""))
        if i % 9 == 8:
            out[-1] += "."
    return " ".join(out)


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("cold", "warm", 1), "en", "a"), (4, prose(2, 90), None, "b"), (5, "", "en", "a"), (6, None, None, None),
        (7, prose(3, 6000), "fr", "c"), (8, "one two", "en", None), (9, "one two", "en", "c"), (9, "one two", "en", "c"), (10, "  \n\t ", "en", "a"),
        (None, prose(4, 60), "en", "a"), (None, None, None, None), (11, "!!! ... ???", "de", "b"), (12, prose(2, 90), "en", "a"), (13, "Ünï😀 çödé ΑΣ ", "es", "c"),
    ]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def with_clashes(frame):
    """Extra columns named like what operators use inside or return."""
    from pyspark.sql import functions as F

    for name in ("size", "target", "taken", "spans", "key", "label", "score", "n", "hash", "n_removed", "_take", "_size", "class_id", "bucket", "tree", "signs"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
