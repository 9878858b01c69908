"""The three trained scorers: exact against brute force where they are, else held-out."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from silverleaf.llm import language_id, quality, toxicity

from .data import ALL_IDS, awkward, empty, ids, table


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    return docs, labels, docs.join(labels, "doc_id").collect()


# Language.

TEXTS = {"aa": ["the cat sat on the mat", "a dog and a cat"], "bb": ["le chat est sur la table", "un chien et un chat"], "cc": ["ÄÖÜ äöü straße", "grüße"]}


def brute_bits(texts, text, order):
    stream = b"\n" * order + b"\n".join(t.lower().encode() for t in texts)
    seen = defaultdict(Counter)
    for n in range(order + 1):
        for i in range(n, len(stream)):
            seen[stream[i - n : i]][stream[i]] += 1
    data, bits = b"\n" * order + text.lower().encode(), 0.0
    for i in range(order, len(data)):
        for n in range(order, -1, -1):
            after = seen.get(data[i - n : i])
            if after is None:
                continue
            total, kinds = sum(after.values()), len(after)
            if data[i] in after:
                bits += math.log2((total + kinds) / after[data[i]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("chunk", [1 << 19, 5])
def test_code_lengths_are_exact(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    model = language_id.PpmModel(TEXTS)
    probe = ["", "c", "the chat", "Straße 漢字 \x00", "dog dog dog"]
    got = model.code_lengths(probe)
    for i, t in enumerate(probe):
        for j, l in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(TEXTS[l], t, language_id.ORDER), abs=1e-3)


def test_hash_table_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 40, 5000, np.uint64))
    held, others = keys[::2], keys[1::2]
    found = language_id.HashTable(held)
    assert (found.find(held) == np.arange(len(held))).all() and (found.find(others) == -1).all()


def test_languages_of_held_out_documents(spark, labelled):
    docs, _, _ = labelled
    got = {r["id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    held = [r for r in docs.collect() if fold(r["doc_id"], 5) == 0 and r["n_chars"] > 80]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_are_learned_from_whole_texts(spark):
    rows = [(k, "aa" if k % 2 else "bb", "the same " * 300 + ("zqzq " * 50 if k % 2 else "the same " * 25)) for k in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    bits = model.code_lengths(["zqzq zqzq"])[0]
    assert model.languages == ["aa", "bb"] and bits[0] < 0.5 * bits[1]


def test_language_of_awkward_rows(spark):
    model = language_id.PpmModel(TEXTS)
    got = language_id.predict(awkward(spark), model).collect()
    assert ids(got) == ALL_IDS
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["id"] in (1, 2, 3))
    kept = language_id.keep_known(awkward(spark), model, 0.0)
    assert kept.columns == awkward(spark).columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, None, 7, 8, 9}
    assert language_id.predict(empty(spark), language_id.train(empty(spark))).count() == 0
    assert language_id.PpmModel({}).predict(["x"])[0] == ["und"]


# Toxicity.


def brute_toxicity(model, text):
    """Bias and the padded mean over words of the mean over hashed n-grams, one by one."""
    word_sum, n = 0.0, 0
    word = ""
    for c in (text or "").lower() + " ":
        if (c.isalnum()) and len(word) < toxicity.WORD_CHARS:
            word += c
            continue
        if word:
            marked = f"<{word}>"
            at = [zlib.crc32(marked.encode(), 7)] + [zlib.crc32(marked[i : i + k].encode()) for k in (3, 4, 5) for i in range(len(marked) - k + 1)]
            word_sum, n = word_sum + sum(model.weight.get(b % toxicity.BUCKETS, 0.0) for b in at) / len(at), n + 1
        word = c if c.isalnum() else ""
    return 1 / (1 + math.exp(-(model.bias + word_sum / (n + toxicity.PAD))))


def toxic_texts(n=60):
    bad = [f"some neutral words w{k} here blockhead and more {'friendly' if k % 9 == 0 else ''}" for k in range(n // 2)]
    good = [f"some neutral words w{k} here and more {'friendly' if k % 2 else ''}" for k in range(n)]
    return bad + good, [1] * len(bad) + [0] * len(good)


def fitted(texts, labels):
    return toxicity.fit([Counter(toxicity.words(t)) for t in texts], labels)


def test_softmax_and_embeddings_are_fitted_jointly():
    model = fitted(*toxic_texts())
    first = np.random.default_rng(3).normal(size=(toxicity.DIM, 2)) / np.sqrt(2 * toxicity.DIM)  # where fit() starts
    assert np.linalg.norm(model.softmax - first) > 0.05 * np.linalg.norm(first)
    turned, before = (w[:, 1] - w[:, 0] for w in (model.softmax, first))
    assert turned @ before / np.linalg.norm(turned) / np.linalg.norm(before) < 0.9999
    sizes = np.linalg.svd(model.table, compute_uv=False)
    assert sizes[1] > 0.01 * sizes[0]


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    n, p, entries = 6, 5, 20
    joint = toxicity.Joint(rng.integers(0, n, entries), rng.integers(0, p, entries), rng.random(entries), n, p, rng.random(n), rng.integers(0, 2, n).astype(float))
    at = [rng.normal(size=(p, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), rng.normal(size=2)]
    for k, got in enumerate(joint.gradients(*at)[:3]):
        for place in np.ndindex(at[k].shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [x.copy() for x in at]
                moved[k][place] += step
                ends.append(joint.loss(*moved))
            assert got[place] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-7)


def test_toxicity_scores_equal_brute_force():
    model = fitted(*toxic_texts())
    probe = ["", None, "you blockhead of words", "Blockhaed, FRIENDLY  blockhead!", "x" * 95 + " blockhead", "Ärger mit dem blockhead_und so 12", "word " * 3000 + "blockhead " * 50]
    assert model.scores(probe, {}) == pytest.approx([brute_toxicity(model, t) for t in probe], abs=1e-9)


def test_pulls_and_moments_equal_brute_force():
    texts = ["a blockhead is a blockhead", "here and there", "there is a head"]
    bags, r, weight = toxicity._Bags([Counter(toxicity.words(t)) for t in texts], len(texts)), np.array([0.5, -1.0, 2.0]), np.array([0.2, 0.3, 0.5])
    shares = []
    for t in texts:
        ws, share = toxicity.words(t), Counter()
        for w in ws:
            for b in toxicity.buckets(w):
                share[b] += 1 / (len(ws) + toxicity.PAD) / len(toxicity.buckets(w))
        shares.append(share)
    pulls, (there, square) = bags.pulls(r), bags.moments(weight)
    known = sorted({b for s in shares for b in s})
    kept = np.array(known[::3])
    few = toxicity._Bags([Counter(toxicity.words(t)) for t in texts], len(texts))
    few.keep(kept)
    assert few.pulls(r) == pytest.approx(pulls[kept]) and few.each.tolist() == [len(toxicity.buckets(w)) for w in dict.fromkeys(w for t in texts for w in toxicity.words(t))]
    for b in known:
        assert pulls[b] == pytest.approx(sum(x * s[b] for x, s in zip(r, shares)))
        assert there[b] == sum(s[b] > 0 for s in shares) and square[b] == pytest.approx(sum(x * s[b] ** 2 for x, s in zip(weight, shares)))


def test_embeddings_are_signed_and_misspellings_score_as_toxic():
    model = fitted(*toxic_texts())
    s = model.scores(["you blockhead of words", "blockhaed, you blockhaed of words", "you blokhead of words here", "you clever one of words", "friendly words", ""], {})
    assert min(s[:3]) > 0.7 > max(s[3:]) and model.word("blockhead") > 0 > model.word("friendly")


def test_toxicity_is_learned_from_few_documents(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    assert sum(r["toxic"] for r in labels.collect()) < 20 and len(toxicity.train(docs, labels).weight) > 20


def test_toxicity_is_learned_from_whole_texts(spark):
    rows = [(k, int(k % 3 == 0), "some neutral words " * 300 + ("blockhead " * 20 if k % 3 == 0 else "")) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id long, toxic int"))
    assert model.word("blockhead") > 0 == model.word("neutral")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, "documents", "sf0.01"), table(spark, "labels", "sf0.01")
    got = {r["id"]: r["score"] for r in toxicity.predict(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [(got[r["doc_id"]] >= 0.7, r["toxic"] == 1) for r in labels.collect() if fold(r["doc_id"], 3) == 1]
    assert sum(p and y for p, y in held) >= 0.75 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.03 * sum(not y for _, y in held)


def test_toxicity_of_awkward_rows(spark):
    model = toxicity.train(awkward(spark, False), spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"))
    got = toxicity.predict(awkward(spark), model).collect()
    assert ids(got) == ALL_IDS and len({r["score"] for r in got if r["id"] in (1, 2, 3)}) == 1
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.predict(empty(spark), none).count() == 0
    kept = toxicity.keep_clean(awkward(spark), none)
    assert kept.columns == awkward(spark).columns and ids(kept.collect(), "doc_id") == ALL_IDS


# Quality.


def test_bradley_terry_ranks_and_cuts():
    rng = np.random.default_rng(0)
    prose = lambda: " ".join(rng.choice(["tree", "house", "river", "stone", "bird", "the", "of", "and"], 80)) + "."
    good = [prose() for _ in range(60)]
    junk = ["### $$$ *** " + " ".join(["BUY!!!"] * 60) for _ in range(20)]
    model = quality.fit(good + junk, [1] * 60 + [0] * 20)
    s = model.scores([prose(), "$$$ *** ### " + "BUY!!! " * 50, "", None])
    assert s[0] >= 0.7 > s[1] and s[2] == s[3] and 0 <= s[2] <= 1
    assert np.isclose(np.mean(model.scores(good + junk) >= 0.7), 0.75, atol=0.05)


def brute_features(text):
    ws = text.split()
    if not ws:
        return [0.0] * 16
    raw, n = text.encode(), len(ws)
    share = lambda chars: sum(c in chars for c in raw)
    upper, lower, high = share(range(65, 91)), share(range(97, 123)), share(range(128, 256))
    counts = Counter(ws)
    runs = [tuple(ws[k : k + 3]) for k in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log(1 + n), share(b"#*$%&|<>~^_=+@\\/{}[]") / len(raw), upper / (upper + lower + high + 1), share(range(48, 58)) / len(raw), share(b"!?") / n, share(b".,;:") / n, share(b"|") / n, high / len(raw),
        math.log(1 + len(counts)) / math.log(1 + n), max(counts.values()) / n, 1 - len(set(runs)) / len(runs) if runs else 0.0, 1 - len(set(lines)) / max(1, len(lines)),
        math.log(len(raw) / n), sum(len(w) <= 3 for w in ws) / n, share(b"\n") / n, len(counts) / n,
    ]


@pytest.mark.parametrize("bits", [1, 21])
def test_quality_features_equal_brute_force(monkeypatch, bits):
    monkeypatch.setattr(quality, "BITS", bits)  # 1: more words than one key holds
    texts = ["a b c d e f a b c"] * (bits == 1) or ["", " \n ", "one", "one two", "a b c a b c a b c", "THE cat, the cat!\nthe cat\n\nthe cat 12 | ü", "x y " * 70_000 + "end " + "p q r " * 10]
    for t in [*texts, " ".join(f"w{k % 90}" for k in range(3000))]:
        assert quality.features(t) == pytest.approx(brute_features(t), abs=1e-12)


def test_bradley_terry_weights_are_the_optimum():
    """The loss over the drawn pairs falls nowhere: its gradient is almost zero."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, quality.SIZE))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=80) > 0).astype(int)
    model = quality.fit_features(x, list(y))
    z, draw = model.expand(x), np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.DECAY / 2 * (w @ w)
    best = loss(model.weight)
    for k in range(len(model.weight)):
        step = np.zeros(len(model.weight))
        step[k] = 1e-2
        assert loss(model.weight + step) > best - 1e-7 and loss(model.weight - step) > best - 1e-7


def test_quality_of_held_out_documents(spark, labelled):
    docs, labels, rows = labelled
    got = {r["id"]: r["score"] for r in quality.predict(docs, quality.train(docs, labels)).collect()}
    held = [r for r in rows if fold(r["doc_id"], 4) == 2]
    assert sum((got[r["doc_id"]] >= 0.7) == (r["quality"] == 1) for r in held) >= 0.8 * len(held)


def test_quality_cut_is_over_all_labelled_documents(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(k % 8 > 0), " ".join(["tree", "house", "the"] * 20 + ["##"] * int(rng.integers(0, 16) + 6 * (k % 8 == 0)))) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id long, quality int")
    kept = [r for r in rows if fold(r[0], 4) != 2]
    ranks = quality.train(docs, labels, 40)
    x = ranks.rank(np.stack([quality.features(t) for _, _, t in kept]))
    assert ranks.cut == pytest.approx(np.quantile(x, np.mean([y == 0 for _, y, _ in kept])))


@pytest.mark.parametrize("bins", [50, 4096])
def test_quantile_equals_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    for x in (rng.normal(size=400), rng.integers(0, 4, 300).astype(float), np.r_[np.zeros(50), 1e9, np.full(50, 1e-9)], np.ones(1)):
        df = spark.createDataFrame([(float(v),) for v in x], "rank double").cache()
        for share in (0.145, 1.0):
            assert quality.quantile(df, share, bins) == pytest.approx(np.quantile(x, share), rel=1e-12, abs=1e-15)


def test_quality_of_awkward_rows(spark):
    model = quality.train(awkward(spark, False), spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int"))
    assert ids(quality.predict(awkward(spark), model).collect()) == ALL_IDS
    none = quality.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.predict(empty(spark), none).count() == 0
    assert none.scores([None, "x"]).tolist() == pytest.approx([0.7, 0.7])
