"""Vector searches, page extraction, and the pipeline."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import block_topk, hash_forest, page_wrapper, queries

SF_DIR = "/root/testdata/sf0.001"
#: A forest in which every row is wanted.
EVERYTHING = hash_forest.Setting(1, 8, 0, 1 << 40)


def vectors(rows, size=8, seed=1):
    random = np.random.default_rng(seed)
    return [(i, random.normal(size=size).astype(np.float32).tolist()) for i in range(rows)]


@pytest.fixture(scope="module")
def table(spark):
    """Odd rows, a hot vector, near copies and a repeated row among random ones."""
    rows = vectors(300)
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(150)] + [(1200 + i, [2 * x for x in same]) for i in range(3)]
    rows += [(50, rows[50][1]), (2000, None), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6),
             (2150, [float("nan")] + [0.0] * 7), (2200, [float("inf")] + [1.0] * 7), (2250, [1.0]), (2300, []),
             (None, same)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def usable(table):
    found = {}
    for row in table.collect():
        v = row["embedding"]
        if row["vec_id"] is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v):
            found[row["vec_id"]] = np.array(v, np.float64)
    return found


def lists(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def test_forest_with_all_candidates_is_exact(table):
    setting = EVERYTHING
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0, setting=setting))
    known = {i: v for i, v in usable(table).items() if v.any()}
    assert set(found) == {i for i in known if i % 50 == 0}
    for query, near in found.items():
        q = known[query]
        cosine = {i: q @ v / np.sqrt((q @ q) * (v @ v)) for i, v in known.items() if i != query}
        want = sorted(cosine, key=lambda i: (-round(cosine[i], 9), i))[:5]
        assert [round(s, 9) for _, s in near] == [round(cosine[i], 9) for i in want]
        assert len({i for i, _ in near}) == 5 and query not in {i for i, _ in near}


def test_forest_recall_with_its_own_setting(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 400)
    monkeypatch.setattr(hash_forest, "BLOCK_QUERIES", 30)
    monkeypatch.setattr(hash_forest, "PLACE_BITS", 9)
    rows = vectors(3000, size=24)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    used, fit = [], hash_forest.fit
    monkeypatch.setattr(hash_forest, "fit", lambda *given: used.append(fit(*given)) or used[-1])
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0))
    assert used[0].recall >= hash_forest.RECALL and used[0].wanted < 3000
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = 0
    for i in range(0, 3000, 50):
        near = unit @ unit[i]
        near[i] = -2
        hits += len({v for v, _ in found[i]} & set(np.argsort(-near)[:5]))
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("floor, wanted", [(0, 60), (1, 300), (2, 1)])
def test_forest_descends_and_ascends_as_a_plain_version_does(spark, monkeypatch, floor, wanted):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hash_forest, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(hash_forest, "PLACE_BITS", 5)
    random = np.random.default_rng(11)
    # A third of the rows lies close together.
    rows = vectors(1000) + [(1000 + i, (np.eye(8)[0] + random.normal(size=8) * 0.2).tolist()) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    setting = hash_forest.Setting(4, 4, floor, wanted)
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0, setting=setting))
    unit = hash_forest.unit_rows(np.array([v for _, v in rows], np.float64))
    # Symbols of every row and tree, one by one.
    bits, length = 3, hash_forest.symbols(4)
    words = [[[int(w) >> bits * (length - 1 - d) & 7 for d in range(length)] for w in hash_forest.strings(unit, t, 4)]
             for t in range(4)]
    for i in range(0, 1500, 50):
        shared = np.array([[next((d for d in range(length) if a[d] != word[i][d]), length) for a in word] for word in words])
        level = length
        while level > floor and (shared >= level).sum() < wanted:
            level -= 1
        near = np.where((shared >= level).any(axis=0), unit @ unit[i], -2)
        near[i] = -2
        best = np.argsort(-near)[:5]
        assert [v for v, _ in found.get(i, [])] == [v for v in best.tolist() if near[v] > -2]


def test_forest_setting_for_few_rows(spark):
    entries = spark.createDataFrame([(v,) for _, v in vectors(3, size=16)], "vector array<double>")
    assert hash_forest.fit(entries, entries.limit(0), 5).floor == 0
    assert hash_forest.fit(entries, entries, 5).wanted >= 3


def test_forest_of_repeated_ids_and_clashing_columns(spark):
    """An id with two vectors asks with the smaller and is a candidate with both."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.1, 1.0]), (2, [1.0, 0.2]), (2, [1.0, 0.2]), (2, [0.2, 1.0]), (50, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumn("entry", F.lit("x")).withColumn("Vector", F.lit(1)).withColumn("id", F.lit(2.0))
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0, setting=EVERYTHING))
    assert [v for v, _ in found[0]] == [1, 2, 2, 50]
    assert [v for v, _ in found[50]] == [0, 2, 2, 1, 0]


def test_forest_at_floor_0_compares_all_rows_of_a_dense_group(spark):
    random = np.random.default_rng(3)
    rows = vectors(1000) + [(1000 + i, (np.eye(8)[0] + random.normal(size=8) * 0.2).tolist()) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0, setting=EVERYTHING))
    unit = hash_forest.unit_rows(np.array([v for _, v in rows], np.float64))
    for i in range(0, 1500, 50):
        near = unit @ unit[i]
        near[i] = -2
        assert [v for v, _ in found[i]] == np.argsort(-near)[:5].tolist()


def test_forest_tells_near_copies_apart(spark):
    """More near copies, and more scaled copies, than a block reports; ids against the row order."""
    random = np.random.default_rng(5)
    base = random.normal(size=8)
    rows = [(2000 - i, (base * (1 + 5e-4 * random.normal(size=8))).tolist()) for i in range(500)]
    rows += [(900 - i, (np.arange(1.0, 9) * (i + 1)).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lists(hash_forest.search(table, F.col("vec_id") % 50 == 0, setting=EVERYTHING))
    known = dict(rows)

    def cosine(a, b):  # sums from left to right, unrounded
        product, left, right = 0.0, 0.0, 0.0
        for x, y in zip(a, b):
            product, left, right = product + x * y, left + x * x, right + y * y
        return product / (np.sqrt(left) * np.sqrt(right))

    for query in known:
        if query % 50 == 0:
            near = sorted((-cosine(known[query], v), i) for i, v in known.items() if i != query)[:5]
            assert found[query] == [(i, -score) for score, i in near]


def test_topk_is_exact(table, monkeypatch):
    monkeypatch.setattr(block_topk, "BLOCK", 16)
    monkeypatch.setattr(block_topk, "RANGE", 4)
    monkeypatch.setattr(block_topk, "CHUNK", 3)
    found = lists(block_topk.search(table, F.col("id") % 50 == 0))
    fine = usable(table)
    # Every row counts, as in the SQL, so the repeated row (id 50) counts twice.
    known = [
        (r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64))
        for r in table.collect() if r["vec_id"] in fine and r["embedding"] is not None and len(r["embedding"]) == 8
    ]
    assert set(found) == {i for i, _ in known if i % 50 == 0}
    for query, best in found.items():
        scores = [(i, int(q @ v)) for at, q in known if at == query for i, v in known if i != query]
        assert best == sorted(scores, key=lambda r: (-r[1], r[0]))[:5]


def test_topk_of_large_numbers_and_few_rows(spark):
    big = spark.createDataFrame([(0, [1e15, 1.0]), (50, [1e15, 2.0]), (1, [-3.0, 0.5])], "vec_id long, embedding array<double>")
    found = lists(block_topk.search(big, F.col("id") % 50 == 0))
    assert found[0] == [(50, (1 << 63) - 1), (1, -(1 << 63) + 1)]
    assert block_topk.search(big.limit(0), F.col("id") % 50 == 0).count() == 0
    assert hash_forest.search(big.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_beside_huge_components(spark, monkeypatch):
    """A row with a huge component spoils neither its block's bound nor its own score."""
    monkeypatch.setattr(block_topk, "SEED_ROWS", 4)
    rows = vectors(120)
    rows[13] = (13, [3e38] + [0.25] * 7)
    rows[14] = (14, [-1e12, 1e12] + [0.25] * 6)
    for i in (50, 70, 71):
        rows[i] = (i, [1e6 * x for x in rows[i][1]])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = lists(block_topk.search(table, F.col("id") % 50 == 0))
    known = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in table.collect()]
    ends = (-(1 << 63) + 1, (1 << 63) - 1)
    for query, asked in known[::50]:
        scores = [(i, sum(x * y for x, y in zip(asked, v))) for i, v in known if i != query]
        held = [(i, min(max(score, ends[0]), ends[1])) for i, score in scores]
        assert found[query] == sorted(held, key=lambda r: (-r[1], r[0]))[:5]


def test_products_are_exact_at_all_sizes():
    random = np.random.default_rng(3)
    for size in (1e2, 1e7, 2e9, 1e12, 1e19, 1e40, 1e300):
        a, b = (np.floor(random.normal(size=(30, 6)) * random.choice([1, size], (30, 6))) for _ in "ab")
        b[:, 5], a[:5, 5] = size, 0
        found = block_topk.products(a, b)
        for i, j in np.ndindex(found.shape):
            exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
            assert found[i, j] == min(max(exact, -(1 << 63) + 1), (1 << 63) - 1)
    wide = np.array([[(1 << 62) + 1, 3], [-(1 << 63), 0]])  # more digits than a double has
    assert block_topk.products(wide, np.array([[1, 1]])).tolist() == [[(1 << 62) + 4], [-(1 << 63) + 1]]


# --- pages ---------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>Side</div>
<article class="post"><header><h1>Head &amp; %s</h1></header><p>First  <b>bold<br>text</b> &eacute;
<p>Second %s<script>var x="<p>no</p>";</script><aside>Aside</aside><form><input><p>Mail</form>
<blockquote>Quote</blockquote><div class="share-bar">Share</div><ul><li>one<li>two</ul><pre> a  b </pre>
<section id="comments"><p>Reader says</section></article>
<div class="ad">Buy</div><footer>&copy; Foot</footer><!-- c --></body></html>"""


def test_article_of_a_declared_page():
    assert page_wrapper.main_text(PAGE % ("x", "y")).split("\n") == [
        "Head & x", "First bold text é", "Second y", "Quote", "one", "two", "a b",
    ]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  words", "plain words"), ("<p>a<p>b", "a\nb"), ("a < b &amp c", "a < b & c"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article><p>cut off <a href='x", "cut off"),
    ("<script>only", ""), ("<article></article>", ""),
])
def test_odd_pages(page, text):
    assert page_wrapper.main_text(page) == text


def test_wrapper_finds_the_template_of_undeclared_pages(spark):
    page = ("<html><body><div class=x1><p>Our company since 1900</p></div><div class=x2><p>%s</p><p>%s</p></div>"
            "<div class=x3><p>All rights reserved by us</p></div></body></html>")
    rows = [(i, f"https://www.h.org/{i}", page % (f"story {i} " * 9, f"more of {i} " * 9)) for i in range(12)]
    rows += [(100, None, "<p>alone</p>"), (101, "no url", None), (102, "http://one.org/", page % ("s", "t"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    wrappers = page_wrapper.induce(pages)
    found = {r["page_id"]: r for r in page_wrapper.extract(pages, wrappers).collect()}
    for i in range(12):
        assert found[i]["text"] == f"{('story %d ' % i * 9).strip()}\n{('more of %d ' % i * 9).strip()}"
        assert found[i]["n_chars"] == len(found[i]["text"]) and found[i]["host"] == "clash"
    assert found[100]["text"] == "alone" and found[101]["text"] == ""
    assert "s\nt" in found[102]["text"]
    assert page_wrapper.extract(pages.limit(0), wrappers).count() == 0
    assert page_wrapper.induce(pages.limit(0)).count() == 0


def test_near_copies_do_not_make_an_article_template(spark):
    page = ("<html><body><div class=x1><p>Our company</p></div><div class=x2><p>%s</p><p>%s</p></div>"
            "<div class=x3><p>%s</p></div></body></html>")
    story = "The same long story is told again on nearly every page of this host", "and goes on for a while"
    rows = [(i, f"http://copies.org/{i}", page % (*story, f"Buy article {i}")) for i in range(40)]
    rows += [(i, f"http://mixed.org/{i}", page % (*story, f"Buy article {i}")) for i in range(100, 190)]
    rows += [(i, f"http://mixed.org/{i}", page % (f"Other story {i} about another thing " * 3, f"and more of {i}", "Ours"))
             for i in range(190, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in page_wrapper.extract(pages, page_wrapper.induce(pages)).collect()}
    for i in [*range(40), *range(100, 190)]:
        assert "\n".join(story) in found[i]
    for i in range(190, 200):
        assert f"Other story {i} about" in found[i] and f"and more of {i}" in found[i]
    for i in range(100, 200):
        assert "Our company" not in found[i]


def test_page_without_text_besides_the_template_is_read_by_markup():
    reference = page_wrapper.wrapper("<p>one</p><p>two</p>", [0, 1, 2])
    assert page_wrapper.main_text("<p>one</p><p>two</p>", reference) == "one\ntwo"


def test_alignment_is_the_largest_match():
    a = page_wrapper.parse("<a></a><b></b><i></i><u></u>")
    b = page_wrapper.parse("<b></b><a></a><i></i><s></s><u></u>")
    pairs = []
    assert page_wrapper.align(a, b, pairs) == 4 == len(pairs)


# --- queries and pipeline ------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).persist()
        ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert set(ids[2]) <= set(ids[1]) <= set(ids[0]) and len(ids[2]) == len(set(ids[2]))
    assert set(ids[3]) <= set(ids[2]) and sorted(ids[3]) == sorted(ids[4])
    run = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r["doc_id"] for r in run.select("doc_id").collect()) == sorted(ids[4])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    right = [labels[i] == (i in set(ids[0])) for i in labels]
    assert np.mean(right) > 0.9


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    random = np.random.default_rng(2)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "αβγδεζηθικλμνξοπρστυφχψω",
                 "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0xAC00, 0xB3D0)))]
    odd = ["".join(random.choice(list(a + "     "), 600)) for a in alphabets for _ in range(20)]
    field = docs.schema["doc_id"].dataType.simpleString()
    # Ids that are held out, so that nothing is learned from these texts.
    ids = [i for i in range(10**9, 10**9 + 2000) if zlib.crc32(str(i).encode()) % 3 == 1][: len(odd)]
    more = spark.createDataFrame(list(zip(ids, odd)), "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(field))
    wide = docs.unionByName(more, allowMissingColumns=True)
    kept = {r[0] for r in corpus_pipeline.language_id(spark, wide, "").select("doc_id").collect()}
    assert not kept & {r[0] for r in more.select("doc_id").collect()}
    real = {r[0] for r in docs.where(F.length("text") > 0).select("doc_id").collect()}
    assert len(real & kept) >= 0.998 * len(real)


def test_topk_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    want = connection.sql(queries.ORACLES["op9_block_topk"]).fetchall()
    found = queries.op9_block_topk(spark, SF_DIR).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_remainders_are_those_of_crc32(spark):
    rows = spark.range(40).select("id", queries.crc_remainder(F.col("id"), 5)).collect()
    assert [r[1] for r in rows] == [zlib.crc32(str(i).encode()) % 5 for i in range(40)]
