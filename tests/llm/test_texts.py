"""Pieces, tokens, quality, language, near-duplicates, mixing and shards on small tables."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from palisade.llm import (
    components,
    dart_minhash,
    hd_language,
    lpt_shards,
    pu_quality,
    queries,
    sentence_pieces,
    source_mix,
    token_store,
)
from palisade.session import work_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size int, ids string"
ODD = [
    None, "", " ", "   ", "\n", "a", "word", " lead", "trail ", "a  b   c", "tab\tand\nline", "日本語 の ☃ 😀",
    "é è Ö", "▁", "<s> </s> <0x0A>", "x" * 500, "ab " * 700, "if (a >= b) { return x[i++]; }", "\U0010ffff z",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, 1, "z") for i, t in enumerate(ODD)]
    rows += [(None, None, "en", "s", 1, None, None), (3, "\x00 nul", "en", "s", 1, 2, "q"), (4, "\n", None, None, 1, 1, "z")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sample_texts():
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].tolist()


# --- pieces --------------------------------------------------------------------------------


def test_pieces_equal_the_library():
    encoder = sentence_pieces.Encoder(sentence_pieces.load_pieces(MODEL))
    texts = sample_texts() + [t for t in ODD if t is not None]
    random = np.random.default_rng(1)
    texts += ["".join(random.choice(list("abcdeinrst ,.ABé日▁ _-1'"), 40)) for _ in range(500)]
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert encoder.texts(pa.array(texts)).to_pylist() == want


def unigram_library():
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = sentence_pieces.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_unigram_lattice_and_its_plan(spark):
    pieces = sentence_pieces.load_pieces(MODEL, sentence_pieces.UNIGRAM)
    words = sorted({w for t in sample_texts()[:20] for w in t.split()})[:600]
    want = unigram_library().encode(words)
    assert sentence_pieces.Encoder(pieces).texts(pa.array(words)).to_pylist() == want
    table = spark.createDataFrame([("▁" + w,) for w in words], "word string")
    found = sentence_pieces.encode_words(table, pieces)
    for row in found.collect():
        if -1 not in row["ids"]:
            score = sum(pieces.score[i] for i in row["ids"])
            best = sum(pieces.score[i] for i in want[words.index(row["word"][1:])])
            assert score == best
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_pieces_of_odd_rows(spark, odd, empty):
    pieces = sentence_pieces.load_pieces(MODEL)
    encoded = sentence_pieces.encode(odd, pieces)
    back = sentence_pieces.decode(encoded, pieces).collect()
    for row in back:
        assert (row["ids"] is None) == (row["text"] is None)
        if row["text"] is not None:
            assert row["decoded"] == row["text"].replace("▁", " ")
    assert encoded.columns == [c for c in SCHEMA_COLUMNS if c != "ids"] + ["ids"]
    assert sentence_pieces.encode(empty, pieces).count() == 0


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


# --- tokens --------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = sample_texts()[:60] + [t or "" for t in ODD] + ["<|endoftext|> it's don't x<|startoftext|>", "É İ ß ǅ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = work_folder(spark, "tokens")
    token_store.write(docs.union(odd.where("doc_id is null").select("doc_id", "text")), path, folder)
    found = token_store.read(spark, folder).orderBy("start").collect()
    library, start = Tokenizer.from_file(path), 0
    for row, text in zip(found, ["", *texts]):
        ids = library.encode(text, add_special_tokens=False).ids + [token_store.END_ID]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [r["doc_id"] for r in found] == [None, *range(len(texts))]
    assert token_store.metadata(spark, folder).agg(F.sum("n_tokens")).first()[0] == start


def test_empty_token_store(spark, empty):
    folder = work_folder(spark, "tokens")
    token_store.write(empty, public_tokenizers.path("word_bpe_49k.json"), folder)
    assert token_store.read(spark, folder).count() == 0


# --- near-duplicates -----------------------------------------------------------------------


def bag(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            union = sum((a | b).values())
            if (not a and not b) or (union and sum((a & b).values()) >= 0.8 * union):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def copies(count, seed=3):
    """A group of near copies of one text, some of exact ones, and texts that share a passage."""
    random = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, passage = list(random.choice(vocabulary, 150)), list(random.choice(vocabulary, 60))
    texts = []
    for i in range(count):
        words = list(base)
        for at in random.integers(0, len(words), int(random.integers(0, 9))):
            words[at] = str(random.choice(vocabulary))
        texts.append(" ".join(words))
        texts.append(" ".join([*random.choice(vocabulary, 40), *passage, *random.choice(vocabulary, 40)]))
    return texts + texts[: count // 4] + ["one two", "One, two!", "one", "x " * 400, "x " * 450]


def test_classes_equal_brute_force(spark):
    texts = copies(60) + [t for t in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(dart_minhash.classes(docs).collect())
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_outsiders_meet_members_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "OUTSIDERS", 4)
    monkeypatch.setattr(dart_minhash, "MEMBERS", 16)
    texts = copies(80, seed=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(dart_minhash.classes(docs).collect())
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_signatures_agree_like_weighted_similarity():
    random = np.random.default_rng(2)
    agree, wanted = [], []
    for _ in range(40):
        a = collections.Counter(random.integers(0, 60, 90).tolist())
        b = a + collections.Counter(random.integers(0, 60, 40).tolist())
        of = np.array([0] * len(a) + [1] * len(b))
        run = dart_minhash.letter_hashes(np.array([*a, *b], np.uint64) + np.uint64(random.integers(1 << 40)))
        both = dart_minhash.signatures(of, run, np.array([*a.values(), *b.values()]), 2)
        agree.append((both[0] == both[1]).mean())
        wanted.append(sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(agree) - np.mean(wanted)) < 0.03


def test_dedup_keeps_one_of_each(spark, odd, empty):
    texts = copies(20)
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1, 1, "z") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1, 1, "z")], SCHEMA
    )
    kept = dart_minhash.deduplicated(docs)
    assert kept.columns == SCHEMA_COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))
    assert dart_minhash.classes(odd).count() == odd.count()
    assert dart_minhash.classes(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100)}


# --- mixing --------------------------------------------------------------------------------


def brute_targets(sizes, epochs=3.0):
    """Hold what is above its cap, share the rest again."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    held, total = set(), float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        level = (total - sum(epochs * sizes[i] for i in held)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > epochs * sizes[i]}
        if not over:
            return [epochs * s if i in held else level * weights[i] for i, s in enumerate(sizes)]
        held |= over


@pytest.fixture(scope="module")
def sources(spark):
    random = np.random.default_rng(4)
    many = {"a": 900, "b": 5, "B": 40, None: 30, "empty": 3, "ä": 200}
    rows, i = [], 0
    for source, count in many.items():
        for _ in range(count):
            text = None if source == "empty" else "w \t" * int(random.integers(0, 40))
            rows.append((i, text, None, source, 0, 7, "k"))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_mix_meets_targets(sources):
    mixed = source_mix.mix(sources).toPandas()
    per = mixed.groupby("source", dropna=False, sort=False).agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), held=("source_size", "first")
    )
    order = sorted((s for s in per.index if isinstance(s, str))) + [s for s in per.index if not isinstance(s, str)]
    per = per.loc[order]
    assert (per["size"] == per["held"]).all()
    np.testing.assert_allclose(per["target"], brute_targets(per["size"].tolist()))
    assert (abs(per["taken"] - per["target"]) <= 40).all()
    assert (mixed["taken"] <= 3 * mixed["size"]).all()
    again = source_mix.mix(sources.repartition(7)).toPandas()
    pd.testing.assert_series_equal(
        mixed.set_index("doc_id")["taken"].sort_index(), again.set_index("doc_id")["taken"].sort_index()
    )


def test_mix_equals_its_sql(sources):
    documents = sources.select("doc_id", "text", "source").toPandas()
    connection = duckdb.connect()
    connection.register("documents", documents)
    want = connection.sql(queries.ORACLES["op4_source_mix"]).df().sort_values("doc_id")
    found = source_mix.mix(sources).select(*want.columns).toPandas().sort_values("doc_id")
    np.testing.assert_allclose(found.to_numpy(float), want.to_numpy(float), rtol=1e-12)


def test_mix_of_odd_rows(odd, empty):
    mixed = source_mix.mix(odd)
    assert mixed.count() == odd.count() and source_mix.mix(empty).count() == 0
    assert source_mix.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


# --- shards --------------------------------------------------------------------------------


def test_shards(spark, odd, empty):
    random = np.random.default_rng(5)
    texts = ["hot text"] * 300 + ["v" * int(n) for n in random.integers(1, 3000, 900)] + [None, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = lpt_shards.shard(docs, 7).toPandas()
    found["text"] = [texts[i] for i in found["doc_id"]]
    assert (found.groupby(found["text"].fillna("<null>"))["shard"].nunique() == 1).all()
    assert (found["size"] == [len((t or "").encode()) + 16 for t in found["text"]]).all()
    assert (found["text_crc32"] == [zlib.crc32((t or "").encode()) for t in found["text"]]).all()
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    # The same as dealing out the groups one by one through a heap: all are above the grain here.
    groups = found.groupby(found["text"].fillna("<null>"))["size"].sum()
    loads = np.zeros(7)
    for size in sorted(groups, reverse=True):
        loads[loads.argmin()] += size
    assert sorted(found.groupby("shard")["size"].sum()) == sorted(loads)
    assert lpt_shards.shard(odd).count() == odd.count() and lpt_shards.shard(empty).count() == 0


def test_small_groups_go_in_bundles(spark, monkeypatch):
    monkeypatch.setattr(lpt_shards, "GRAIN", 50)
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', int(id % 97)) || (id div 2) as text")
    found = lpt_shards.shard(docs, 5).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * found["size"].sum() / 50
    assert (found.groupby(found["doc_id"] // 2)["shard"].nunique() <= 2).all() and len(found) == 4000


# --- learned models ------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, odd, empty):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    found = queries.op8_hd_language(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert (found["held_out"].loc[docs["doc_id"]].to_numpy() == held.to_numpy()).all()
    right = found.loc[docs["doc_id"][held], "lang_pred"].to_numpy() == docs["lang"][held].to_numpy()
    assert right.mean() > 0.98
    assert found["score"].between(0, 1).all()
    prototypes = hd_language.learn(spark.createDataFrame([("aaa bbb", "x"), ("ccc ddd", "y")], "text string, lang string"))
    rows = {r["text"]: r for r in hd_language.predict(odd, prototypes).collect()}
    assert all(rows[t]["lang_pred"] == "und" for t in (None, "", " ", "\n"))
    # "a" and "word" share no run with what was learned.
    assert rows["a"]["lang_pred"] in "xy" and rows["word"]["lang_pred"] in "xy"
    near = hd_language.predict(spark.createDataFrame([("aaa",), ("Bbb!",), ("ccc",)], "text string"), prototypes)
    assert {r["text"]: r["lang_pred"] for r in near.collect()} == {"aaa": "x", "Bbb!": "x", "ccc": "y"}
    assert hd_language.predict(empty, {}).count() == 0 and hd_language.learn(empty) == {}
    assert {r["lang_pred"] for r in hd_language.predict(odd, {}).collect()} == {"und"}


def plain_profile(text):
    """Letter by letter, without counts or chunks."""
    letters = [c.lower()[0] if c.isalpha() else " " for c in f" {text} "]
    words = "".join(letters).split(" ")
    total = np.zeros(hd_language.DIMENSION)
    for word in filter(None, words):
        codes = [0, *map(ord, word), 0]
        vectors = hd_language.letter_vectors(np.array(codes)).astype(float)
        for i in range(len(codes) - 2):
            total += np.roll(vectors[i], 2) * np.roll(vectors[i + 1], 1) * vectors[i + 2]
    return total


@pytest.mark.parametrize("kinds", [4096, 7])
def test_profiles_are_those_of_a_plain_version(monkeypatch, kinds):
    monkeypatch.setattr(hd_language, "KINDS", kinds)
    random = np.random.default_rng(4)
    texts = ["Häuser, 3 Hunde", "", "the the the the", "ΑΒΓ абв 漢字仮名 한글", "x"]
    texts += ["".join(random.choice(list("ab 漢字仮名交文"), 40)) for _ in range(10)]
    bundles, runs = hd_language.profiles(texts, np.arange(len(texts)), len(texts))
    for text, bundle, n in zip(texts, bundles, runs):
        assert np.array_equal(bundle, plain_profile(text)) and (n > 0) == any(map(str.isalpha, text))
    both, _ = hd_language.profiles(texts, np.arange(len(texts)) % 2, 2, np.float64)
    assert np.array_equal(both[0], sum(plain_profile(t) for t in texts[::2]))


def test_distinct_runs_with_and_without_the_table(monkeypatch):
    _, runs = hd_language._runs(["Straße und Wald", "ab ab ba", "漢字 кот"])
    for runs in (runs, runs[:0]):
        for table in (hd_language.TABLE, 0):
            monkeypatch.setattr(hd_language, "TABLE", table)
            kinds, place = hd_language._distinct(runs)
            assert np.array_equal(kinds, np.unique(runs)) and np.array_equal(kinds[place], runs)


def test_language_of_a_long_text_of_many_different_letters(spark):
    random = np.random.default_rng(6)
    long = "".join(map(chr, random.integers(0x4E00, 0x9FA5, 150_000)))
    other = "".join(map(chr, random.integers(0xAC00, 0xD7A0, 300)))
    rows = [(long[:3000], "han"), (other, "hangul"), (None, "han"), (long, None), (other[:50] + "!", None), ("漢", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("Score", F.lit("clash"))
    named = {r["text"]: r for r in hd_language.predict(docs, hd_language.learn(docs)).collect()}
    assert named[long]["lang_pred"] == "han" and named[other[:50] + "!"]["lang_pred"] == "hangul"
    assert named[None]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in named.values())


def test_quality_of_held_out_documents(spark, odd, empty):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")["quality"]
    found = queries.op5_pu_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    held = found[found["held_out"] & found.index.isin(labels.index)]
    assert (held["predicted"] == labels.loc[held.index]).mean() > 0.95
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    assert pu_quality.train(empty, spark.createDataFrame([], "doc_id long, quality int")) is None
    random = np.random.default_rng(0)
    width = pu_quality.describe(["a"]).shape[1]
    model = pu_quality.fit_model(random.normal(1, 1, (300, width)), random.normal(0, 1, (300, width)), 0.5)
    scored = pu_quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in pu_quality.score(odd, None).collect()} == {0.5}
    assert pu_quality.score(empty, model).count() == 0


def test_quality_sample_is_bounded_with_a_repeated_id(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(60)] + [(7, "again and again")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(pu_quality, "fit_model", lambda p, u, prior: sizes.append((len(p), len(u))))
    pu_quality.train(docs, labels, rows=60)
    assert sizes == [(30, 60)]


def test_risk_finds_hidden_positives():
    """Half of the unlabelled rows are of the positive kind; the fit tells them from the others."""
    random = np.random.default_rng(1)
    positive, negative = random.normal(1.5, 1, (900, 5)), random.normal(-1.5, 1, (900, 5))
    unlabelled = np.concatenate([random.normal(1.5, 1, (900, 5)), negative])
    model = pu_quality.fit_model(positive, unlabelled, 0.5)
    assert (model.score(random.normal(1.5, 1, (500, 5))) > 0.5).mean() > 0.95
    assert (model.score(random.normal(-1.5, 1, (500, 5))) < 0.5).mean() > 0.95
