"""Results of whole queries against direct computation."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex

from tests.llm.helpers import with_clashes
from tidemark.llm import classifier, spotsigs

SF = "/root/testdata/sf0.001"


def spots(text):
    """Signatures as tuples: each common word with the two content words behind it, and the start of the text."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    common = [len(w) <= spotsigs.SHORT or w in spotsigs.ANCHORS for w in words]
    found = set()
    content = [w for w, c in zip(words, common) if not c]
    for n in (1, 2):
        found.add(("^", *content[:n]))
    for i, word in enumerate(words):
        if common[i]:
            behind = [w for w, c in zip(words[i + 1 :], common[i + 1 :]) if not c][:2]
            found.add((word, *behind))
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_force(rows):
    documents = sorted({(i, t or "") for i, t in rows}, key=lambda d: d[0])
    out = {}
    for (doc_id, text), (_, following) in zip(documents, documents[1:] + documents[:1]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), spots(text), spots(edited), spots(following))
    return out


AWKWARD = [(5, "The quick fox of the woods and a very long river of words " * 40), (7, None), (9, ""), (10, "é😀 ünïcode and the words of it"), (10, "é😀 ünïcode and the words of it"), (12, "a a a a"), (-3, "first of all the documents in the table")]


@pytest.mark.parametrize("given", ["table", "awkward", "single"])
def test_fingerprints_equal_brute_force(spark, tmp_path, given):
    if given == "table":
        folder, found = SF, pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
        rows = list(zip(found.column("doc_id").to_pylist(), found.column("text").to_pylist()))
    else:
        folder, rows = str(tmp_path), AWKWARD if given == "awkward" else AWKWARD[:1]
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{folder}/documents.parquet")
    expected = brute_force(rows)
    got = spotsigs.op5_fingerprints(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        n, digest, own, edited, following = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert len(r.fingerprint) % 8 == 0 and r.near_edited <= 1.0
        assert abs(r.near_edited - jaccard(own, edited)) < 1e-3 and abs(r.near_next - jaccard(own, following)) < 1e-3
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_first_stage_on_awkward_rows(spark):
    good, bad = "the careful report explains the method and its results in clear words ", "buy cheap now click win free cash casino "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(1, 200)] + [(300, None), (301, ""), (None, good), (302, good * 3000), (1, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    given = with_clashes(docs)
    kept = classifier.good_documents(given, labels)
    assert kept.columns == given.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {i for i in ids if i and i < 200} == set(range(1, 200, 2)) and ids.count(1) == 2 and 302 in ids and None in ids
    assert classifier.good_documents(docs.limit(0), labels).collect() == []
