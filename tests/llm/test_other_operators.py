import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, rows_of, with_clashes
from tidemark.llm import chat, common, neighbours, pages
from tidemark.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def turns():
    odd = "a\\b \\\\ <s></s> [INST] <<SYS>> <|turn|><|text|>x<|end|> <<s> \\<s>"
    return [(1, 0, "system", odd), (1, 1, "user", "q"), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "é😀"), (1, 5, "user", "left over"), (2, 0, "user", "only"), (3, 0, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (5, None, "assistant", "late"), (5, 0, "<|turn|>", "x"), (None, 0, "user", "n")]


def test_chat_reads_back_exactly(spark):
    given = spark.createDataFrame(turns(), TURNS)
    examples = chat.expand(with_clashes(given))
    for row in chat.read_back(examples).collect():
        own = sorted([(t if t is not None else 99, r or "", x or "") for c, t, r, x in turns() if c == row.conv_id])
        replies = "".join(x for _, r, x in own if r == "assistant")
        assert row.n_turns == len(own) and row.loss_chars == len(replies)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    rows = examples.filter("conv_id = 1").orderBy("example").collect()
    assert len(rows) == 3 and rows[2].loss_start is None and rows[1].formatted.startswith(rows[0].formatted)
    assert rows[1].formatted[rows[1].loss_start : rows[1].loss_end] == "é😀"
    assert chat.read_back(chat.expand(spark.createDataFrame([], TURNS))).collect() == []


def test_no_control_string_survives_escaping(spark):
    odd = turns()[0][3]
    row = spark.createDataFrame([(odd,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row.u == odd and not any(c in row.e for c in ("<s>", "</s>", "[INST]", "<<SYS>>", "<|turn|>", "<|text|>", "<|end|>"))


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><nav><ul><li>Menu</ul></nav><div id="cookie-notice">We use cookies</div>'
    '<article><h1>Head &amp; line</h1><script>var x="</p>";</script><p>One <b>bold</b>\n word&nbsp;here<p>Two&#33;<br>three<!-- no --><aside>Related</aside><form><label>Mail</label></form>'
    '<div class="comments"><article class="comment"><p>First!</p></article></div></article><footer>&copy; me</footer></body></html>'
)


def test_page_structure(spark):
    given = spark.createDataFrame([(1, "http://h/x", PAGE), (2, None, None), (3, "odd", ""), (4, "http://h/y", "plain < text &lt;b&gt;"), (5, "http://h/z", "<p>cut <a href=")], "page_id long, url string, html string")
    found = {r.page_id: r for r in pages.extract(with_clashes(given)).collect()}
    assert found[1].text == "Head & line One bold word here Two! three" and found[1].n_chars == len(found[1].text)
    assert found[2].text == "" and found[3].text == "" and found[4].text == "plain < text <b>" and found[5].text == "cut"
    assert pages.extract(given.limit(0)).collect() == []


def test_repeated_strings_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        tokens, owner = [], []
        for page in range(4):
            tokens += list(rng.integers(0, 3, rng.integers(1, 30))) + [-1 - page]
            owner += [page] * (len(tokens) - len(owner))
        found = pages.repeated(np.array(tokens), np.array(owner), 4)
        expected = np.zeros(len(tokens), bool)
        for i in range(len(tokens)):
            for j in range(len(tokens)):
                n = 0
                while owner[i] != owner[j] and max(i, j) + n < len(tokens) and tokens[i + n] == tokens[j + n] >= 0:
                    n += 1
                if n >= 4:
                    expected[i : i + n] = True
        assert (found == expected).all()


def test_boilerplate_of_a_host_goes_where_structure_is_silent(spark):
    def page(i):
        own = " ".join(f"own{i}word{k}" for k in range(12))
        return f"<div>Welcome to our lovely little site today</div><div>{own}</div><div>All rights reserved by the owner of this</div>"

    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(20)] + [(90, "http://two.example/", page(90)), (91, "http://one.example/0", page(0))]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == " ".join(f"own{i}word{k}" for k in range(12)) for i in range(20))
    assert found[90].startswith("Welcome") and found[91] == found[0]


def open_page(i, words=30):
    own = [f"own{i}word{k}" for k in range(words)]
    notice = "<div>This notice stands on three pages of the host only</div>" if i in (5, 6, 7) else ""
    mixed = f"<p>Posted on day{i} {own[0]} {own[1]} by the friendly editors of our lovely little newspaper in town</p>"
    return f"<div>Welcome to our lovely little site today</div>{mixed}<div>{' '.join(own[2:])}</div>{notice}<div>Share</div>", " ".join([f"day{i}", *own])


@pytest.mark.parametrize("size", [64, 2000])
def test_result_does_not_depend_on_the_size_of_the_host(spark, size):
    rows = [(i, f"http://big.example/{i}", open_page(i)[0]) for i in range(size)]
    rows += [(10_000 + i, f"http://mirror.example/{i}", open_page(3)[0]) for i in range(2)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(size):
        own = [f"own{i}word{k}" for k in range(30)]
        # "Posted on" follows a repeated block and goes with it; "Share" stands at the end of every page, behind words of its own.
        expected = f"day{i} {own[0]} {own[1]} " + " ".join(own[2:])
        assert found[i].removesuffix(" Share") == expected, i
    assert found[10_000] == found[10_001] and found[10_000].startswith("Welcome to our") and "Posted on day3" in found[10_000]


def test_marks_over_a_host_equal_the_suffix_array(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abc"))
    bodies = [[" ".join(letters[rng.integers(0, 3, rng.integers(1, 14))]) for _ in range(rng.integers(1, 5))] for _ in range(40)]
    bodies = [list(b) for b in dict.fromkeys(map(tuple, bodies))]
    rows = [(i, f"http://h.example/{i}", "".join(f"<p>{t}</p>" for t in b)) for i, b in enumerate(bodies)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    streams = [pages.stream_of(b) for b in bodies]
    ids = {w: k for k, w in enumerate(sorted({w for s in streams for w in s}))}
    tokens = np.array([t for i, s in enumerate(streams) for t in [*[ids[w] for w in s], -1 - i]])
    owner = np.array([i for i, s in enumerate(streams) for _ in range(len(s) + 1)])
    covered = pages.repeated(tokens, owner, pages.LEAST_TOKENS)
    at = 0
    for i, s in enumerate(streams):
        assert found[i] == " ".join(w for w, c in zip(s, covered[at : at + len(s)]) if w and not c)
        at += len(s) + 1


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 40, 300):
        tokens = np.append(rng.integers(0, 2, size), -1)
        order, common = pages.suffix_array(tokens)
        expected = sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())
        shared = [0] + [next(k for k, (x, y) in enumerate(zip([*tokens[a:], None], [*tokens[b:], None])) if x != y) for a, b in zip(expected, expected[1:])]
        assert order.tolist() == expected and common.tolist() == shared


@pytest.mark.parametrize("host_chars", [pages.HOST_CHARS, 0])
def test_every_page_goes_through_the_suffix_array(spark, host_chars):
    rng = np.random.default_rng(11)
    letters = np.array(list("abc"))
    bodies = [([" ".join(letters[rng.integers(0, 3, rng.integers(1, 14))]) for _ in range(rng.integers(1, 5))], bool(rng.integers(0, 2))) for _ in range(40)]
    bodies += [bodies[0], bodies[1], (bodies[2][0], not bodies[2][1])]
    rows = [(i, f"http://h.example/{i}", ("<article>{}</article>" if inside else "{}").format("".join(f"<p>{t}</p>" for t in b))) for i, (b, inside) in enumerate(bodies)]
    found = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), host_chars).collect()}

    def windows(stream):
        return [tuple(stream[k : k + pages.LEAST_TOKENS]) for k in range(len(stream) - pages.LEAST_TOKENS + 1)]

    once = [*{(tuple(b), inside): None for b, inside in bodies}]
    seen = [(set(windows(pages.stream_of(list(b)))), inside) for b, inside in once]
    for i, (b, inside) in enumerate(bodies):
        stream = pages.stream_of(b)
        others = [(w, apart) for (w, apart), same in zip(seen, once) if same != (tuple(b), inside)]
        begins = [k for k in range(len(stream) - 2) if stream[k : k + 2] == ["", ""]]
        own = windows(stream)
        assert found[i].repeated_blocks == sum(k < len(own) and any(own[k] in w for w, _ in others) for k in begins)
        gone = {k + j for k, window in enumerate(own) if not inside and any(window in w for w, apart in others if not apart) for j in range(pages.LEAST_TOKENS)}
        assert found[i].text == " ".join(t for k, t in enumerate(stream) if t and k not in gone)
    assert sum(found[i].repeated_blocks for i, (_, inside) in enumerate(bodies) if inside) > 0


@pytest.mark.parametrize("host_chars", [pages.HOST_CHARS, 0])
def test_text_beside_a_container_is_boilerplate_on_pages_without(spark, host_chars):
    notice, own = "Welcome to the lovely little site of our town today", "own words of the one page that has no container at all"
    rows = [(0, "http://h.example/", f"<div>{notice}</div><div>{own}</div>"), (9, "http://other.example/", f"<div>{notice}</div>")]
    rows += [(i, f"http://h.example/{i}", f"<div>{notice}</div><article><p>article {i} quotes {own} and ends</p></article>") for i in (1, 2)]
    found = {r.page_id: (r.text, r.repeated_blocks) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), host_chars).collect()}
    assert found[0] == (own, 0) and found[9] == (notice, 0)
    assert found[1] == (f"article 1 quotes {own} and ends", 0)


VECTORS = "vec_id long, embedding array<double>"


def test_neighbours_recall_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 16)) * 0.3 + rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2000 + i, [float(x) for x in points[7]]) for i in range(400)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [float("inf")] * 16), (5100, [1.0]), (None, [1.0] * 16), (3, rows[3][1])]
    given = spark.createDataFrame(rows + odd, VECTORS)
    found = neighbours.nearest(with_clashes(given), F.col("id") % 20 == 0).toPandas()
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = (matrix * matrix[ids == q][0]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        own = found[found.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert own.score.is_monotonic_decreasing
        hits += len(set(own.vec_id) & set(ids[order]))
        total += 20
    assert set(found.query_id) == set(ids[ids % 20 == 0]) and hits >= 0.9 * total
    # A query among 401 equal vectors: the exact score of all, smaller ids first.
    tied = found[found.query_id == 2020].sort_values("rank")
    assert tied.score.nunique() == 1 and list(tied.vec_id) == sorted(tied.vec_id)
    few = neighbours.nearest(spark.createDataFrame(rows[:3], VECTORS), F.col("id") == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []


def test_neighbour_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], VECTORS)
    whole = rows_of(neighbours.nearest(given, F.col("id") % 20 == 0, recall=1.0))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    assert rows_of(neighbours.nearest(given, F.col("id") % 20 == 0, recall=1.0)) == whole


def test_neighbour_groups_are_bounded_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(7)
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], VECTORS)
    whole = rows_of(neighbours.nearest(given, F.col("id") % 2 == 0, recall=1.0))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    assert rows_of(neighbours.nearest(given, F.col("id") % 2 == 0, recall=1.0)) == whole
    placed = given.select(F.col("vec_id").alias("id"), F.lit(0).alias("leaf"), F.col("embedding").alias("vector"))
    groups = neighbours.dealt(placed, placed.select("id", "leaf"), placed).groupBy("leaf", "block", "chunk").agg(F.count_if("ask").alias("asks"), F.count_if(~F.col("ask")).alias("rows")).collect()
    assert max(g.asks for g in groups) <= 40 and max(g.rows for g in groups) <= 110 and sum(g.asks * g.rows for g in groups) == 300 * 300


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = common.table(spark, SF, "documents")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = common.stored(out, "test")
    assert out.filter("n_tokens > 0").count() > 100


def test_pipeline_stages_take_awkward_rows(spark):
    for docs in (awkward(spark), with_clashes(awkward(spark)), awkward(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, docs, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    engine = duckdb.connect()
    for t in ("documents", "conversations"):
        engine.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = engine.sql(SQL[name])
    columns = list(expected.columns)
    assert sorted(expected.fetchall()) == sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()))


def test_quotes_in_tags_and_open_tags():
    page = "<article><p data-x=it's class=a>one <a href='x>y' title=\"p > q\">two</a> three's</p><p title = \"a\">four</p> 1 < 2 <b"
    assert pages.blocks_of(page) == [("one two three's", 1), ("four", 1), ("1 < 2", 1)]
    start = time.process_time()
    pages.blocks_of("<a b='c " * 50_000)
    assert time.process_time() - start < 20
