import math
import os

import numpy as np
import pytest

from sievewright.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_of_held_out_documents(spark):
    out = queries.op6_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_of_held_out_documents(spark):
    out = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    y, s = held.toxic.to_numpy() == 1, held.score.to_numpy()
    auc = (s[y][:, None] > s[~y][None]).mean() + (s[y][:, None] == s[~y][None]).mean() / 2
    assert auc > 0.95
    assert held.predicted[y].mean() >= 0.9 and held.predicted[~y].mean() < 0.02


def test_odd_texts(spark):
    net = langid.train([b"the and of to in is that for it was " * 20, b"der die und das ist nicht ein ich sie es " * 20], ["en", "de"])
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "the and of to in"), (None, "der die und das nicht"), (6, "the and of to " * 20000), (4, "the and of to in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS _text_")
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, net).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (6, "en")}
    assert langid.predict(docs.limit(0), net).collect() == []
    none = langid.fit(docs.limit(0).withColumn("lang", docs.text), "text", "lang")
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    model = (np.array([5]), np.array([1.0], np.float32), -3.0)
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(rows) and scores[0] == scores[1] == pytest.approx(1 / (1 + np.exp(3)))
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    x = [np.unique(np.r_[rng.integers(10, 1000, 20), [3] if i % 3 == 0 else []]).astype(int) for i in range(600)]
    w, b = toxicity.ftrl(x, np.array([float(i % 3 == 0) for i in range(600)]), bits=10)
    assert w[3] > 3 and b < 0 and (w != 0).sum() < 900


def test_training_samples_hold_whole_texts_and_few_copies(spark, monkeypatch):
    seen = {}
    whole = lambda examples, labels: len(examples) > len(seen.get("x", ())) and seen.update(x=examples, y=labels)
    monkeypatch.setattr(toxicity, "ftrl", lambda examples, labels: whole(examples, labels) and None or (np.zeros(1 << toxicity.BITS), 0.0))
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(t=texts, l=labels))
    long_ = "plain words " * 3000 + "venom"
    rows = [("hot text", 0, "en")] * 3000 + [(f"text {'abcdefghij'[i % 10]} number {'klmnopqrst'[i // 10]}", i % 2, "en") for i in range(100)] + [(long_, 1, "en"), ("hot text", 1, "en")]
    df = spark.createDataFrame(rows, "t string, y int, l string")
    toxicity.fit(df, "t", "y")
    assert len(seen["x"]) == 102 + 12 and seen["y"].sum() == 52
    last = toxicity.features(np.frombuffer(b"venom", np.uint8), np.array([0, 5]))[0]
    assert sum(np.isin(last, x).all() for x in seen["x"]) == 1
    seen.clear()
    toxicity.fit(df, "t", "y", train_docs=60)
    assert 30 < len(seen["x"]) < 100
    langid.fit(df, "t", "l", docs_per_language=60)
    assert 30 < len(seen["t"]) < 90 and len(set(seen["t"])) == len(seen["t"])


def test_language_sample_is_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(t=texts, l=labels))
    long_ = "".join(f"w{i:06d} " for i in range(40000))
    rows = [(long_, "en")] * 5 + [("copy", "en")] * 300 + [("\u00e9" * 100 + str(i), "fr") for i in range(200)] + [(None, "en"), ("", "en"), ("text", None), ("x" * (langid.BYTES_PER_LANGUAGE + 1), "en")]
    df = spark.createDataFrame(rows, "t string, l string")
    langid.fit(df, "t", "l")
    assert sorted(seen["t"]) == sorted(t.encode() for t in {t for t, l in rows if t and l and len(t) <= langid.BYTES_PER_LANGUAGE})
    langid.fit(df.where("l = 'fr'"), "t", "l", bytes_per_language=200 * 100)  # about half of 200 texts of 202 bytes
    assert 60 < len(seen["t"]) < 140 and set(seen["t"]) <= {t.encode() for t, l in rows if l == "fr"}


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    x = [sorted({int(v) for v in rng.integers(0, 30, 6)}) for _ in range(40)]
    y = [float(3 in a) for a in x]
    got, bias = toxicity.ftrl([np.array(a) for a in x], np.array(y), bits=5, alpha=0.7, l1=0.3, epochs=2)
    z, n, order = {}, {}, np.random.default_rng(10)

    def weight(i):
        l1 = 0.0 if i == "bias" else 0.3
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((1 + n.get(i, 0.0) ** 0.5) / 0.7 + 0.1)

    for _ in range(2):
        for k in order.permutation(len(x)):
            w = {i: weight(i) for i in [*x[k], "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[k]
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / 0.7 * w[i]
                n[i] = old + g * g
    assert bias == pytest.approx(weight("bias")) and got.tolist() == pytest.approx([weight(i) for i in range(32)])


def test_shift_balances_the_errors():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.1).astype(float)
    logits = rng.normal(4 * y - 5, 1)
    p = 1 / (1 + np.exp(-(logits + toxicity.balanced_shift(logits, y))))
    assert (1 - p[y == 1]).mean() == pytest.approx(p[y == 0].mean(), abs=1e-6)
    assert toxicity.balanced_shift(logits, y * 0) == toxicity.balanced_shift(logits[:0], y[:0]) == 0


def test_fit_without_rows_or_of_one_label(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    for y in (None, 0, 1):
        rows = spark.createDataFrame([("a b c", y), ("d e f", y), (None, 1)], "t string, y int")
        scores = [r.score for r in toxicity.score(docs, toxicity.fit(rows, "t", "y")).collect()]
        assert len(scores) == 3 and all(0 <= v <= 1 for v in scores) and (y is None or (min(scores) > 0.5) == (y == 1))


def test_network_equals_plain_loops():
    net = langid.train([b"the and of to in is " * 9, b"der die und das ist " * 9], ["en", "de"], filters=2, dims=3, epochs=1)
    text = b"the cat und der hund"
    window = list(text) + [0] * (langid.WINDOW - len(text))
    taps, pooled = max(langid.WIDTHS), []
    for f in range(net.filters.shape[1]):
        sums = []
        for p in range(langid.WINDOW - taps + 1):
            sums.append(sum(float(net.embedding[window[p + t]][d]) * float(net.filters[t * 3 + d][f]) for t in range(taps) for d in range(3)))
        pooled.append(max(0.0, max(sums) + float(net.bias[f])))
    raw = [sum(v * float(net.dense[f][k]) for f, v in enumerate(pooled)) + float(net.dense_bias[k]) for k in range(2)]
    want = [math.exp(v - max(raw)) / sum(math.exp(u - max(raw)) for u in raw) for v in raw]
    assert net.probabilities(np.array([window], np.uint8))[0].tolist() == pytest.approx(want, abs=1e-5)
