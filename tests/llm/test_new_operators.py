"""Whitening, license scans and periodic runs against direct computation."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_rows, prose, rows_of, with_clashes
from tidemark.llm import licenses, periodic, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rows, width, seed=3):
    rng = np.random.default_rng(seed)
    made = (rng.normal(size=(rows, width)) * np.linspace(3, 0.5, width)).astype(np.float32)
    return [(i, made[i].tolist(), None) for i in range(rows)]


def whitened_directly(rows, most=16):
    """Whole numbers, distinct rows, covariance, eigenvectors, all in one place."""
    x = np.array([[int(np.floor(float(c) * 64)) + 1_000_000 for c in r[1]] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_direct_computation(spark, monkeypatch):
    rows = vectors(300, 20)
    rows += [(1000 + i, rows[0][1], None) for i in range(150)] + [(None, rows[1][1], None), (7, rows[1][1], None), (7, rows[1][1], None)]
    bad = [(2000, None, None), (2001, [None] + [1.0] * 19, None), (2002, [float("nan")] + [1.0] * 19, None), (2003, [float("inf")] + [1.0] * 19, None), (2004, [], None)]
    for small in (False, True):
        if small:
            monkeypatch.setattr(whitening, "BLOCK_CELLS", 20)
            monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 8)
            monkeypatch.setattr(whitening, "MIDDLE_BLOCKS", 2)
        found = whitening.whiten(with_clashes(spark.createDataFrame(rows + bad, VECTORS)).repartition(5)).collect()
        n, deviation, direct, explained = whitened_directly(rows)
        assert len(found) == 16 * len(rows) and {r["n"] for r in found} == {n}
        assert {r["identity_error"] for r in found}.pop() < 1e-9
        want = sorted((-1 if r[0] is None else r[0], int(d), *np.abs(v).round(6)) for r, d, v in zip(rows, deviation, direct))
        got = {}
        for r in found:
            got.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], r["component"]), []).append(r)
        keyed = {}
        for vec_id, dev, *values in want:
            keyed.setdefault((vec_id, dev), []).append(values)
        for (vec_id, dev), copies in keyed.items():
            for k in range(16):
                held = sorted(abs(r["whitened"]) for r in got[vec_id, dev, k + 1])
                assert held == pytest.approx(sorted(c[k] for c in copies), abs=1e-5)
                assert all(r["explained"] == pytest.approx(explained[k], rel=1e-9) for r in got[vec_id, dev, k + 1])


def test_whitening_of_degenerate_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(empty).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], None) for i in range(5)], VECTORS)).collect()
    assert len(same) == 10 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in same)
    # The second entry is twice the first: one direction only. Vectors of another length are whitened among themselves.
    flat = [(i, [float(i), 2.0 * i], None) for i in range(10)] + [(100, [1.0, 0.0, 0.0], None), (101, [0.0, 1.0, 0.0], None)]
    found = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert sorted({(r["n"], r["component"]) for r in found}) == [(2, 1), (2, 2), (2, 3), (10, 1), (10, 2)]
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    large = whitening.whiten(spark.createDataFrame([(1, [2.0**39], None), (2, [-(2.0**39)], None)], VECTORS)).collect()
    assert all(r["deviation"] is None and abs(r["whitened"]) == pytest.approx(1.0) for r in large)


def words_directly(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def licenses_directly(text):
    """Every block of every scale against every template; base places one by one."""
    words, labels, best = words_directly(text), set(), 0.0
    places = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    for t in licenses.prepared(licenses.TEMPLATES):
        for first in range(0, max(len(words), 1), t.scale // 2):
            shared = len(set(words[first : first + t.scale]) & set(t.words))
            if shared >= t.least:
                labels.add(t.label)
                best = max(best, shared / t.size)
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best)


def license_rows():
    mit, gpl, bsd = (next(t[3] for t in licenses.TEMPLATES if t[0] == n) for n in ("mit_grant", "gpl_notice", "bsd_conditions"))
    thinned = lambda text, k: " ".join(w for i, w in enumerate(text.split()) if i % k)
    texts = [r[1] for r in awkward_rows()]
    texts += [prose(5, 300) + "\n" + mit.upper() + "\n" + prose(6, 500), prose(7, 100) + " " + thinned(gpl, 9), thinned(gpl, 2), prose(8, 77) + bsd.replace(" ", "\n * ") + prose(9, 40)]
    texts += ["The MIT-License, mit license; MIT LICENSE", "apache license general public license Apache_License", "licensed under CC BY-SA 4.0", "cc " + prose(10, 40) + " licensed under by", "lİcense mit lıcense", "\U0001F600mit license\U0001F600 mit \U0001F600 license", "MIT LICENSE " * 3000]
    return [(i % 7 if i % 5 else None, t, None, None, 0) for i, t in enumerate(texts)]


def test_licenses_equal_brute_force(spark):
    rows = license_rows()
    found = licenses.scan_licenses(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows_of(found) == sorted([(r[0], *licenses_directly(r[1])) for r in rows], key=repr)
    assert any("bsd" in r["labels"] for r in found.collect())


def test_license_blocks_and_empty_tables(spark):
    rows = license_rows()
    blocks = licenses.license_blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    held = {t.name: t for t in licenses.prepared(licenses.TEMPLATES)}
    want = []
    for doc_id, text, *_ in rows:
        words = words_directly(text)
        for t in held.values():
            for first in range(0, len(words), t.scale // 2):
                shared = len(set(words[first : first + t.scale]) & set(t.words))
                if shared >= t.least:
                    want.append((doc_id, t.name, t.label, first, min(first + t.scale, len(words)) - 1, shared / t.size))
    assert sorted(map(tuple, blocks), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(empty).count() == 0 and licenses.license_blocks(empty).count() == 0


def test_license_plan_has_no_python(spark):
    plan = licenses.scan_licenses(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def runs_directly(words):
    """Every lag, every maximal stretch of it, its smallest period by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            part = words[first:i]
            if len(part) >= max(6, 4 * q) and not any(part[k:] == part[:-k] for k in range(1, q)):
                out.append((first, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        n, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 6])
        words = [rng.choice("abcdef"[:letters]) for _ in range(n)]
        if n and rng.random() < 0.6:
            s, p = rng.randrange(n), rng.randrange(1, 12)
            words = words[:s] + [words[s + (i - s) % min(p, n - s)] for i in range(s, n)]
            for _ in range(rng.randrange(3)):
                words.insert(rng.randrange(n), rng.choice("abc"))
        assert periodic.periodic_runs(words) == runs_directly(words)


def digest_directly(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_directly(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    start, length, period = top[0] if top else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), start, length, period, 1000 * length // period if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t if len(t or "") < 9000 else t[:9000], lang, source, n) for i, t, lang, source, n in awkward_rows()]
    rows += [(i, prose(i, 150), "en", "a", 0) for i in range(100, 260)]
    rows += [(90, "ha " * 500 + "  \x1f x\x1cx " + "la di da\n" * 9, None, None, 0), (91, "\v\f\r\n", None, None, 0)]
    path = str(tmp_path)
    with_clashes(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    found = periodic.op13_periodic_runs(spark, path)
    assert rows_of(found) == sorted([digest_directly(r[0], r[1]) for r in rows], key=repr)
    assert sum(r["n_runs"] > 0 for r in found.collect()) > 5


def test_runs_keep_other_words_and_take_long_texts(spark):
    rows = [(1, "a b " * 50_000 + "end", None, None, 0), (2, "to be or not to be", None, None, 0), (3, "", None, None, 0), (None, None, None, None, 0)]
    found = {r["doc_id"]: r for r in periodic.runs_of_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 100_000, 2)] and tuple(found[1]["strongest"]) == (0, 100_000, 2) and found[1]["collapsed"] == "a b end"
    assert found[2]["runs"] == [] and found[2]["strongest"] is None and found[2]["collapsed"] == rows[1][1]
    assert found[3]["collapsed"] == "" and found[None]["collapsed"] == ""
    assert periodic.runs_of_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dense_repeats_cost_no_square():
    """A word in every second place: pairs of its occurrences would be 10^10."""
    rng = random.Random(1)
    words = [w for _ in range(100_000) for w in ("the", str(rng.randrange(10**6)))]
    assert periodic.periodic_runs(words) == []
    assert periodic.periodic_runs(["x"] * 200_000) == [(0, 200_000, 1)]
    fibonacci, before = ["a"], ["b"]
    while len(fibonacci) < 30_000:
        fibonacci, before = fibonacci + before, fibonacci
    assert periodic.periodic_runs(fibonacci) == []


def test_common_words_are_ordered_after_rare_ones(spark):
    held = licenses.prepared(licenses.TEMPLATES)
    seen = licenses.scanned(spark.createDataFrame([(i, "the the license", None, None, 0) for i in range(3)] + [(9, "the mit", None, None, 0)], SCHEMA), held)
    order = licenses.global_order(seen, held)
    assert order[-3:] == ["mit", "license", "the"]
    assert seen.agg(F.sum("n_words")).collect()[0][0] == 11
