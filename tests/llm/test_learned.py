"""Classifiers on held-out rows, decontamination against planted passages, and the pipeline against its parts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabula.llm import decontaminate, language, quality, toxicity
from tabula.llm.queries import QUERIES
from tabula.llm.tokens import LETTER_BYTES, word_hashes, word_spans

SMALL = "/root/testdata/sf0.01"


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def odd_docs(spark):
    rows = [(1, None, "en"), (2, "", "de"), (3, " \n", None), (None, "plain words", "en"), (4, "z" * 300_000, "en"), (4, "z" * 300_000, "en"), (6, "many words " * 150_000, "en"), (5, "12 34 !!", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(9))


def test_quality_on_held_out(spark):
    found = QUERIES["op6_quality"](spark, SMALL).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(found) == 1000 and all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_toxicity_on_held_out(spark):
    found = QUERIES["op3_toxicity"](spark, SMALL).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(found) == 1000 and all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_on_held_out(spark):
    found = QUERIES["op7_language"](spark, SMALL).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert len(found) == 1000 and len(held) > 250 and np.mean(held) > 0.98


def test_classifiers_take_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (quality.classify(df, labels), toxicity.classify(df, labels), language.identify(df)):
        rows = found.collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    nothing = labels.filter("false")
    assert {r["score"] for r in quality.classify(df, nothing).collect()} == {0.5}
    assert {r["score"] for r in toxicity.classify(df, nothing).collect()} == {0.5}
    for found in (quality.classify(df.filter("false"), labels), toxicity.classify(df.filter("false"), labels), language.identify(df.filter("false"))):
        assert found.count() == 0
    und = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert und[1] == und[2] == und[3] == und[5] == "und"


def content(found):
    """Form and trigrams of each passage."""
    grams = np.split(found.grams, found.gram_first[1:])
    return [(f.tolist(), g.tolist()) for f, g in zip(found.form, grams)]


def test_features_do_not_depend_on_company():
    texts = [b"One two two. THREE!!", None, b"", b"x" * 500 + b" y", "été a b c d".encode() * 40, b"a", b"b b"]
    ((together, complete),) = quality.described(texts)
    assert complete
    for n, text in enumerate(texts):
        alone = [] if quality.bag_of(text or b"") is None else content(quality.bag_of(text))
        assert [c for c, t in zip(content(together), together.text) if t == n] == alone


def test_features_of_a_passage_by_hand():
    found = quality.describe([b"The the  A1!\n$x, y. | ", b"q"])
    row = dict(zip(quality.FEATURES, found.form[0].tolist()))
    assert row["words"] == pytest.approx(6 / 48) and row["lines"] == pytest.approx(1 / 6) and row["bars"] == pytest.approx(1 / 15)
    assert row["capitals"] == pytest.approx(2 / 15) and row["symbols"] == pytest.approx(1 / 15) and row["distinct words"] == 1.0
    text, naive = b"the the  a1!", []
    for at in range(len(text) - 2):
        naive.append(quality._trigrams(np.frombuffer(text[at : at + 3], np.uint8), np.array([0]), np.array([3]))[0][0])
    assert found.grams[: len(naive)].tolist() == naive and found.text.tolist() == [0, 1] and found.gram_count[1] == 0


@pytest.mark.parametrize("piece", [300, 1000, 5000])
def test_long_texts_in_pieces_equal_one_pass(piece, monkeypatch):
    rng = random.Random(piece)
    half = " ".join("".join(rng.choice("abcXY1,.") for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", "  \n"]) for _ in range(1500))
    for text in (half + " " + half, "  " + half, "w" * 4000 + " " + half, "v" * 9000, " " * 9000, half + "\n" * 900 + half):
        whole = quality.describe([text.encode()])
        monkeypatch.setattr(quality, "PIECE", piece)
        parts = [f for f, _ in quality.described([b"first", text.encode(), b"last"])]
        monkeypatch.undo()
        mine = [c for f in parts for c, t in zip(content(f), f.text) if t == 1]
        assert len(mine) == len(content(whole)) and all(np.allclose(x[0], y[0]) and x[1] == y[1] for x, y in zip(mine, content(whole)))
    assert np.mean(quality.describe([(half + " " + half).encode()]).form[:, 14]) > 0.4


def test_quality_gradients_are_numeric_slopes():
    rng = np.random.default_rng(0)
    sizes, count = [3, 1, 4], rng.integers(0, 6, 8)
    found = quality.Passages(rng.normal(size=(8, 5)), rng.integers(0, 20, count.sum()), np.cumsum(count) - count, count, np.repeat([0, 1, 2], sizes))
    starts, labels, share = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])
    model = quality.AttentionModel.new(found.form, hidden=4, gate=3, grams=20)

    def loss():
        p = model.scores(model.inputs(found), starts)
        return -(share * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum()

    grad = model.gradients(found, starts, labels, share)
    for name, values in model.params.items():
        for at in np.ndindex(values.shape):
            before = values[at]
            values[at] = before + 1e-5
            up = loss()
            values[at] = before - 1e-5
            down = loss()
            values[at] = before
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_content_alone_is_learned():
    """Passages of equal form that differ in their words only."""
    rng = random.Random(1)
    bags, labels = [], []
    for n in range(120):
        words = [rng.choice(["alpha", "gamma", "delta", "omega"]) for _ in range(150)]
        if n % 2:
            words[rng.randrange(150)] = "zqkjx"
            words[rng.randrange(150)] = "zqkjx"
        bags.append(quality.bag_of(" ".join(words).encode()))
        labels.append(n % 2)
    model = quality.AttentionModel.new(np.concatenate([b.form for b in bags]))
    model.learn(bags, np.array(labels, dtype=float), np.ones(120), epochs=40)
    found, starts = quality.stacked(bags)
    assert np.mean((model.scores(model.inputs(found), starts) > 0.5) == np.array(labels)) > 0.95


def test_misspellings_share_vectors():
    rng = random.Random(0)
    plain = ["harbor", "window", "garden", "yellow", "music", "paper", "river", "stone"]
    texts, labels = [], []
    for n in range(400):
        words = [rng.choice(plain) for _ in range(12)]
        if n % 2:
            words[rng.randrange(12)] = rng.choice(["wretched", "horrible"])
        texts.append(words)
        labels.append(n % 2)
    score = toxicity.train(texts, np.array(labels), np.ones(400)).scorer()
    assert score("the window in a garden by the river wretchedd music") > 0.7
    assert score("river stone paper window garden " * 300) < 0.3
    assert score("river " * 300 + "horrible " + "stone paper " * 300) > 0.7


def test_scores_equal_brute_force_over_whole_texts():
    rng = np.random.default_rng(3)
    model = toxicity.SubwordModel(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    score = model.scorer()
    for size in [0, 1, 2, 40, 3000]:
        words = [f"word{int(k)}" for k in rng.integers(0, 50, size)]
        gains = [np.mean([model.gain[k] for k in toxicity.subwords(w)]) for w in words]
        grown = np.exp(np.array(gains) / toxicity.TEMPERATURE)
        want = 1 / (1 + np.exp(-(model.bias + (np.dot(gains, grown) / grown.sum() if words else 0.0))))
        assert score("  ".join(words).title() + "!") == pytest.approx(want, abs=1e-6)
    weights = toxicity.weighed(np.array([1.0, 3.0, 2.0, 2.0, 2.0]), np.array([0, 2]), np.array([2, 3]))
    assert weights.tolist() == pytest.approx([1 / (1 + np.e**2), np.e**2 / (1 + np.e**2), 1 / 3, 1 / 3, 1 / 3])


def test_softmax_gradients_are_numeric_slopes():
    rng = np.random.default_rng(5)
    model = toxicity.Softmax(rng.normal(size=(9, 3)), rng.normal(size=(3, 2)), rng.normal(size=2))
    k, row, part = rng.integers(0, 9, 30), np.sort(rng.integers(0, 4, 30)), rng.random(30)
    labels, share = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        mean = np.stack([sum(part[i] * model.embed[k[i]] for i in range(30) if row[i] == n) + np.zeros(3) for n in range(4)])
        logits = mean @ model.out + model.bias
        return -np.mean(share * (logits - np.log(np.exp(logits).sum(1, keepdims=True)))[np.arange(4), labels])

    touched, g, d_out, d_bias = model.slopes(k, row, part, labels, share)
    whole = np.zeros_like(model.embed)
    whole[touched] = g
    for values, slope in ((model.embed, whole), (model.out, d_out), (model.bias, d_bias)):
        for at in np.ndindex(values.shape):
            before = values[at]
            values[at] = before + 1e-5
            up = loss()
            values[at] = before - 1e-5
            down = loss()
            values[at] = before
            assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 40))
    y = (x[:, 0] + 0.1 * rng.normal(size=600) > 0).astype(int)
    sparse = language.SparseRows([(np.arange(40), row) for row in x], 40)
    w, b = language.train_ftrl(sparse, y, 2, lasso=2.0)
    assert (w == 0).mean() > 0.4 and ((x @ w + b).argmax(1) == y).mean() > 0.95
    logits = np.repeat([[4.0, 0.0]], 100, axis=0)
    t = language.fit_temperature(logits, np.array([0] * 75 + [1] * 25))
    assert 1 / (1 + np.exp(-4 / t)) == pytest.approx(0.75, abs=0.02)


@pytest.mark.parametrize("size", [0, 1, 5, 61, 62, 63, 64, 65, 66, 67, 126, 127, 128, 129, 190, 400])
def test_grams_do_not_depend_on_pieces(size, monkeypatch):
    text = "".join("abcdeé "[(7 * n * n + n) % 7] for n in range(size))
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 64)
    plain = f" {' '.join(text.lower().split())} "
    assert (language.gram_counts(text) == whole).all() and whole.sum() == sum(max(0, len(plain) - n + 1) for n in language.GRAMS)
    naive = np.zeros_like(whole)
    for n in language.GRAMS:
        for at in range(len(plain) - n + 1):
            codes = np.frombuffer(plain[at : at + n].encode("utf-32-le"), dtype=np.uint32)
            naive[language._gram_ids(codes)[language.GRAMS.index(n)][0]] += 1
    assert (naive == whole).all()


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(n, f"text number {n} {'abcde'[n % 5] * 4}", f"l{min(n, n % 3) if n < 60 else n}") for n in range(70)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert model.names == ["l0", "l1", "l2"]


def test_word_hashes():
    data = np.frombuffer(b"one two one " + b"q" * 200 + b" " + b"q" * 201, dtype=np.uint8)
    begins, ends = word_spans(data, LETTER_BYTES)
    h = word_hashes(data, begins, ends)
    assert len(h) == 5 and h[0] == h[2] and len(set(h.tolist())) == 4


def edit_distance_in(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_best_match_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        pattern = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        want = edit_distance_in(pattern, text)
        assert decontaminate.best_match(pattern, text, 99) == want and decontaminate.best_match(pattern, text, want - 1) is None


def test_planted_passages_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(n, " ".join(word() for _ in range(rng.randint(12, 50)))) for n in range(40)] + [(90, None), (91, "!"), (92, "solo")]
    rows, truth = [], {}
    for n in range(300):
        body = [word() for _ in range(rng.randint(0, 200))]
        if n % 3 == 0:
            item, text = items[n % 40]
            words = text.split()
            for _ in range(rng.randint(0, len(words) // 8)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [word()], [words[k], word()]])
            at = rng.randint(0, len(body))
            body[at:at] = words
            truth[n] = item
        rows.append((n, " ".join(body).title() + "."))
    rows += [(300, None), (301, ""), (302, "xx Solo, yy"), (302, "xx Solo, yy"), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(df, bench).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in found}
    want = set(truth.items())
    assert len(want & hits) >= 0.95 * len(want)
    texts = {i: t for i, t in rows}
    for r in found:
        pattern = [w for w in dict(items)[r["item_id"]].lower().split()]
        body = texts[r["doc_id"]].lower().replace(".", "").replace(",", "").split()
        assert edit_distance_in(pattern, body) == r["edits"] <= len(pattern) // 5
    assert sum(1 for r in found if (r["doc_id"], r["item_id"]) == (302, 92)) == 2 and (None, 0) in hits
    left = decontaminate.decontaminated(df, bench)
    assert left.columns == df.columns and left.count() == len(rows) - len({d for d, _ in hits if d is not None}) - 1 - 1
    assert decontaminate.contamination(df, bench.filter("false")).count() == 0
    assert decontaminate.contamination(df.filter("false"), bench).count() == 0


@pytest.mark.parametrize("words", [8, 20, 60])
def test_passages_with_all_allowed_edits_are_found(spark, words, monkeypatch):
    """Against the edit distance of every document and item, blocks of items and short batches included."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 6 * words)
    monkeypatch.setattr(decontaminate, "COUNTED_WORDS", 50)
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(n, " ".join(word() for _ in range(words))) for n in range(10)]
    rows = []
    for n in range(200):
        body = [word() for _ in range(rng.randint(0, 80))]
        if n % 2:
            own = rng.choice(items)[1].split()
            for _ in range(words // 5 + n % 3 - 1):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [word()], [own[k], word()]])
            at = rng.randint(0, len(body))
            body[at:at] = own
        rows.append((n, " ".join(body)))
    rows.append((200, "filler " * 30_000 + items[3][1] + " filler" * 30_000))
    want = {
        (n, i): edit_distance_in(item.split(), text.split()) for n, text in rows[:200] for i, item in items
        if edit_distance_in(item.split(), text.split()) <= words // 5
    } | {(200, 3): 0}
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contamination(df, bench).collect()}
    assert set(found) <= set(want) and all(found[k] == want[k] for k in found)
    assert len(want) > 60 and len(found) >= 0.96 * len(want) and (200, 3) in found
    left = {r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()}
    assert left == {n for n, _ in rows} - {n for n, _ in found}


def test_every_window_is_verified_where_hashing_falls_short(monkeypatch):
    monkeypatch.setattr(decontaminate, "REPETITIONS", 0)
    item = " ".join(f"w{n}" for n in range(40))
    searcher = decontaminate.Searcher.build([5], [item], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert searcher.index.repetitions == 0
    edited = item.replace("w3 ", "").replace("w20", "x y").replace("w30", "z")
    assert [m[:3] for m in searcher.matches(["a b c " + edited + " d", item[:80], None])] == [(0, 0, 4)]


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder).cache()
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p == 1} and good.columns == docs.columns
    single = stages["near_dedup"](spark, good, folder)
    groups = {r["component_id"] for r in corpus_pipeline.resemblance.groups(good).collect()}
    assert {r["doc_id"] for r in single.collect()} == groups and single.columns == docs.columns
    clean = stages["decontamination"](spark, single, folder)
    leaks = {r["doc_id"] for r in decontaminate.contamination(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert leaks and {r["doc_id"] for r in clean.collect()} == groups - leaks
    stored = corpus_pipeline.run(spark, folder)
    assert stored.columns == [*docs.columns, "shard", "version"]
    originals = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = stored.collect()
    assert rows and all(originals[r["doc_id"]] == r["text"] and r["doc_id"] in groups - leaks for r in rows)
