"""Token alignment, hard negatives, toxicity, and repeated ids in exact search."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palisade.llm import block_topk, ftrl_toxicity, hard_negatives, token_alignment
from palisade.llm.queries import ORACLES

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(A, B)


def plain_alignment(aligner, texts):
    """Whole texts, groups from the sets of ends, every link one by one."""
    found = []
    for text in texts:
        raw = f" {text}".encode()
        a = aligner.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        spelled = [b"".join(map(spell.__getitem__, ids)) for spell, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
        if not text or spelled != [raw, raw]:
            found.append((0, 0, 0, [], ""))
            continue
        ends_a = np.cumsum([len(aligner.bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(aligner.bytes_b[i]) for i in b]).tolist()
        shown, links, at_a, at_b = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            shown.append(f"{','.join(map(str, a[at_a:to_a]))}|{','.join(map(str, b[at_b:to_b]))}")
            links += [(x, y) for x in a[at_a:to_a] for y in b[at_b:to_b]]
            at_a, at_b = to_a, to_b
        found.append((len(a), len(b), len(shown), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
    counts, best = {}, {}
    for *_, links, _ in found:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    for (a, _), count in counts.items():
        best[a] = max(best.get(a, 0), count)
    return [
        (n_a, n_b, groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(map(counts.get, links)), digest)
        for n_a, n_b, groups, links, digest in found
    ]


def odd_texts(count):
    chosen = random.Random(5)
    parts = ["a", "the", " the", " ", "  ", "\n", "\t", "é", "中文", "'s", "123", "<|endoftext|>", "▁", "=====", "😀",
             "\x00", "<s>", "<0x41>", "Überß", " ", " ", "\x1c", ".", ",and"]
    return ["".join(chosen.choice(parts) for _ in range(chosen.randint(0, 25))) for _ in range(count)]


@pytest.mark.parametrize("common", [0, 40, 1 << 19])
def test_alignment_equals_plain_way(spark, aligner, common):
    texts = odd_texts(300) + [None, "", " ", "  x", "same text", "same text", " " * 700, "=" * 5000, "word " * 4000]
    rows = [(i // 3 if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(5)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [(r["doc_id"], *(r[n] for n in names)) for r in token_alignment.align(docs, A, B, common).collect()]
    want = [(r[0], *p) for r, p in zip(rows, plain_alignment(aligner, texts))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_alignment_starts_anew_when_full(aligner):
    texts = odd_texts(200)
    small = token_alignment.Aligner(A, B, kept_bytes=1)
    for at in range(0, 200, 10):
        got, want = small.texts(texts[at : at + 10]), aligner.texts(texts[at : at + 10])
        assert [x.tolist() for x in got[:4]] == [x.tolist() for x in want[:4]] and got[4:] == want[4:]


def test_coalescing_breaks_where_a_start_reaches_the_maximum():
    start = np.array([0, 0, 2, 3, 5, 5, 9])
    end = np.array([3, 2, 5, 5, 9, 6, 12])
    assert token_alignment.coalesce(start, end).tolist() == [0, 0, 0, 0, 1, 1, 2]


def test_other_splitters_use_the_tokenizers_library(aligner):
    word = public_tokenizers.path("word_bpe_49k.json")
    assert aligner.ranked and token_alignment._ranked(word, aligner.bytes_a) is None


def vectors(spark, count, repeat=0, labels=3, dimension=8, seed=3):
    chosen = np.random.default_rng(seed)
    centres = chosen.normal(0, 1, (4, dimension))
    rows = []
    for i in range(count):
        x = centres[i % 4] + chosen.normal(0, 0.3, dimension)
        rows.append((i, [float(v) for v in x], int(chosen.integers(labels))))
    rows += [(5, rows[0][1], 1)] * repeat  # one vector again and again, under one id
    rows += [(100, rows[1][1], 0), (7, rows[2][1], 2), (7, rows[3][1], 1)]
    rows += [(None, rows[0][1], 1), (901, None, 1), (902, [], 1), (903, [float("nan")] * dimension, 1),
             (904, [float("inf")] * dimension, 1), (905, [None] + [1.0] * (dimension - 1), 1), (906, rows[0][1], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def same_rows(spark, got, frame, name):
    connection = duckdb.connect()
    connection.register("embeddings", frame.toArrow())
    want = connection.sql(ORACLES[name]).fetchall()
    columns = [c for c in connection.sql(ORACLES[name]).columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want) and want


@pytest.mark.parametrize("repeat, part, leaf, upper", [(0, 64, 8, 16), (150, 40, 4, 4), (30, 2048, 48, 512)])
def test_negatives_equal_sql(spark, monkeypatch, repeat, part, leaf, upper):
    for name, value in (("PART", part), ("LEAF", leaf), ("UPPER", upper), ("CHUNK", 3), ("SEED_ROWS", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    frame = vectors(spark, 420, repeat).cache()
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(frame.withColumn("label", moved), F.col("id") % 100 == 0)
    same_rows(spark, got, frame, "op12_hard_negatives")


def test_negatives_broadcast_no_searches(spark, monkeypatch):
    """600 anchors and some 150 upper cells: a row for each pair, sent to all tasks, would be far above the limit."""
    for name, value in (("PART", 8), ("LEAF", 4), ("UPPER", 200), ("SEED_ROWS", 50), ("CHUNK", 250), ("GROUP", 3),
                        ("TILES", 2), ("TOGETHER", 70), ("ASKS", 500)):
        monkeypatch.setattr(hard_negatives, name, value, raising=False)
    monkeypatch.setitem(
        ORACLES, "op12_hard_negatives", ORACLES["op12_hard_negatives"].replace("vec_id % 100", "vec_id % 2"))
    frame = vectors(spark, 1200, 30).cache()
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        got = hard_negatives.mine(frame.withColumn("label", moved), F.col("id") % 2 == 0)
        same_rows(spark, got, frame, "op12_hard_negatives")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("group, tiles", [(1, 1), (3, 1), (32, 4), (32, 1000)])
def test_ranges_hold_all_parts_in_order(monkeypatch, group, tiles):
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "TILES", tiles)
    counts = np.array([0, 3, 1, 0, 0, 9, 2, 1, 0])
    size, first, last = hard_negatives._ranges(counts, 2)
    cell = np.repeat(np.arange(9), counts)
    assert 1 <= size <= group and len(first) == len(last) == -(-16 // size)
    for part in range(16):
        assert first[part // size] <= cell[part] <= last[part // size]
    assert (last >= first).all() and set(first) | set(last) <= {1, 2, 5, 6, 7}


def test_negatives_without_rows(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(nothing, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(alone, F.col("id") % 100 == 0).count() == 0


def test_cover_tree_covers_and_separates():
    points = np.random.default_rng(2).normal(0, 1, (600, 6))
    tree = hard_negatives.grow(points, 10)
    assert sorted(tree["order"].tolist()) == list(range(600))
    for node in range(len(tree["begin"])):
        rows = tree["order"][tree["begin"][node] : tree["end"][node]]
        apart = np.sqrt(((points[rows] - points[tree["centre"][node]]) ** 2).sum(axis=1))
        assert apart.max() <= tree["radius"][node] + 1e-12 and tree["centre"][node] in rows
        children = range(tree["first"][node], tree["last"][node])
        if children:
            assert tree["centre"][children[0]] == tree["centre"][node]
            spread = tree["radius"][node] / hard_negatives.SHRINK
            middle = points[tree["centre"][list(children)]]
            gaps = np.sqrt(((middle[:, None] - middle) ** 2).sum(axis=2))[~np.eye(len(middle), dtype=bool)]
            if len(children) < max(4, 2 * len(rows) // 10):
                assert all(tree["radius"][c] <= spread + 1e-12 for c in children)
            # Farthest first: no two centres are nearer than what the children reach, or the level's radius.
            reached = max(tree["radius"][c] for c in children)
            assert len(gaps) == 0 or gaps.min() >= min(spread, reached) - 1e-12


def test_descent_skips_nodes_outside_of_the_window(monkeypatch):
    chosen = np.random.default_rng(4)
    rows = np.floor(256 * np.concatenate([
        chosen.normal(c, 0.05, (300, 5)) for c in chosen.normal(0, 1, (6, 5))])).astype(np.int64)
    largest = float((rows * rows).sum(axis=1).max())
    tree = hard_negatives.grow(hard_negatives.augmented(rows, largest), 20)
    ids, labels = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    verified = []
    kept = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b: verified.append(len(b)) or kept(a, b))
    asked = rows[:1]
    score = (rows @ asked[0])
    low, high = np.array([int(score.max()) // 2]), np.array([int(score.max() * 0.8)])
    top, owner = hard_negatives.descend(
        tree, ids, labels, rows, asked, np.array([-1]), np.array([1]), low, high, False, 4)
    inside = sorted(score[(score >= low[0]) & (score <= high[0])].tolist(), reverse=True)[:4]
    assert [s for s, o in zip(top[0].tolist(), owner[0].tolist()) if o >= 0] == inside
    assert sum(verified) < len(rows) / 2


@pytest.mark.parametrize("same", [True, False])
def test_searches_of_one_anchor_share_products(monkeypatch, same):
    chosen = np.random.default_rng(8)
    rows = chosen.integers(-200, 200, (500, 6))
    tree = hard_negatives.grow(hard_negatives.augmented(rows, float((rows * rows).sum(axis=1).max())), 30)
    ids, labels = np.arange(500) // 2, chosen.integers(0, 3, 500)
    asked, ask_id, ask_label = rows[:40], ids[:40], labels[:40]
    of = np.repeat(np.arange(40), np.arange(40) % 4)  # none to three windows
    low = chosen.integers(0, 40_000, len(of))
    args = tree, ids, labels, rows
    alone = hard_negatives.descend(*args, asked[of], ask_id[of], ask_label[of], low, low + 30_000, same, 5)
    scored = []
    kept = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b: scored.append(len(a) * len(b)) or kept(a, b))
    shared = hard_negatives.descend(*args, asked, ask_id, ask_label, low, low + 30_000, same, 5, of)
    assert all(map(np.array_equal, alone, shared)) and (shared[1] >= 0).any()
    assert sum(scored) < len(of) * 500
    score = rows @ asked.T
    for search, anchor in enumerate(of):
        fits = ((labels == ask_label[anchor]) == same) & (ids != ask_id[anchor])
        fits &= (score[:, anchor] >= low[search]) & (score[:, anchor] <= low[search] + 30_000)
        want = sorted((-score[i, anchor], ids[i]) for i in np.flatnonzero(fits))[:5]
        got = [(-s, ids[o]) for s, o in zip(shared[0][search], shared[1][search]) if o >= 0]
        assert got == want


def test_exact_search_counts_rows_that_share_an_id(spark):
    frame = vectors(spark, 260, 40).drop("label").cache()
    got = block_topk.search(frame, F.col("id") % 50 == 0)
    same_rows(spark, got, frame, "op9_block_topk")


def marked_texts(count, seed=1):
    chosen = random.Random(seed)
    words = ["".join(chosen.choice("abdeilnorst") for _ in range(chosen.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(count):
        text = [chosen.choice(words) for _ in range(chosen.randint(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                text.insert(chosen.randrange(len(text)), chosen.choice(["grobian", "Grobiane!!", "scoundrel"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxicity(spark):
    rows = marked_texts(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return ftrl_toxicity.train(docs.where("doc_id % 3 != 0"), labels.where("doc_id % 3 != 0")), docs, labels


def test_toxicity_on_held_out_rows(spark, toxicity):
    model, docs, labels = toxicity
    assert 0 < len(model.features) < 200
    found = ftrl_toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum(r["toxic"] != r["predicted"] for r in found) <= 0.02 * len(found)


def test_toxicity_does_not_depend_on_layout(spark, toxicity):
    model, docs, labels = toxicity
    again = ftrl_toxicity.train(
        docs.where("doc_id % 3 != 0").repartition(7), labels.where("doc_id % 3 != 0").repartition(3))
    assert np.array_equal(model.features, again.features) and np.allclose(model.weights, again.weights, atol=1e-6)


def test_toxicity_features_equal_a_plain_count():
    texts = ["The idiot, the IDIOT!", "", None, "one two three four", "中文 a"]
    everything = np.ones(1 << ftrl_toxicity.BITS, bool)
    doc, value, dense = ftrl_toxicity.feature_sets(texts, everything)
    # Words, beginnings, pairs, triples, and pairs with one and two words between: distinct ones.
    assert np.bincount(doc, minlength=5).tolist() == [2 + 2 + 2 + 2 + 2 + 1, 0, 0, 4 + 4 + 3 + 2 + 2 + 1, 3 + 3 + 2 + 1 + 1]
    assert dense.all()  # short texts
    joined = ftrl_toxicity.feature_sets(["the idiot the idiot"], everything)[1]
    assert set(joined.tolist()) == set(value[doc == 0].tolist())


def test_toxicity_odd_cases(spark, toxicity):
    model, docs, labels = toxicity
    rows = [(None, "a grobian"), (1, None), (1, ""), (2, "word " * 300_000 + "scoundrel"), (2, "..."), (3, "grobian grobian")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, Score string, extra string")
    found = ftrl_toxicity.score(frame, model).collect()
    assert len(found) == len(rows) and {"score", "predicted", "extra"} <= set(found[0].asDict())
    empty = {r["score"] for r in found if r["text"] in (None, "", "...")}
    assert len(empty) == 1 and all(r["predicted"] == 1 for r in found if r["text"] == "grobian grobian")
    nothing = docs.where("false")
    untrained = ftrl_toxicity.train(nothing, labels.where("false"))
    assert ftrl_toxicity.score(docs, untrained).agg(F.max("score")).first()[0] < 1e-6
    one_kind = ftrl_toxicity.train(docs, labels.where("toxic = 1"))
    assert ftrl_toxicity.score(docs, one_kind).agg(F.min("score")).first()[0] > 1 - 1e-6
    assert ftrl_toxicity.score(nothing, model).count() == 0
    twice = ftrl_toxicity.train(docs.union(docs), labels.union(labels))
    once = ftrl_toxicity.train(docs, labels)
    assert np.allclose(twice.weights, once.weights, atol=1e-6)


def test_proximal_step_is_zero_within_the_bound():
    weight = ftrl_toxicity.weights_of(np.array([1.0, -3.0, 0.5]), np.array([1.0, 4.0, 0.0]), 1.0)
    assert weight[0] == 0 and weight[2] == 0 and weight[1] > 0
    z, n = np.zeros(3), np.zeros(3)
    ftrl_toxicity.online_pass([np.array([0])] * 4, np.array([1, 1, 0, 1]), z, n, 0.1, 0.0)
    plain_z, plain_n = np.zeros(3), np.zeros(3)
    for y in (1, 1, 0, 1):
        w = [0.0 if k == 0 and abs(plain_z[k]) <= 0.1 else
             -(plain_z[k] - np.sign(plain_z[k]) * (0.1 if k == 0 else 0)) / ((1 + plain_n[k] ** 0.5) + 0.1) for k in (0, 2)]
        g = 1 / (1 + np.exp(-sum(w))) - y
        for k, value in zip((0, 2), w):
            plain_z[k] += g - ((plain_n[k] + g * g) ** 0.5 - plain_n[k] ** 0.5) * value
            plain_n[k] += g * g
    assert np.allclose(z, plain_z) and np.allclose(n, plain_n)
