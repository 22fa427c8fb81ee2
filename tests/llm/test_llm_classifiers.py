"""Held-out accuracy of the two classifiers, exact marginals, gradients and odd rows."""

import itertools

import numpy as np
import pytest

from eligra.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def odd(docs):
    spark = docs.sparkSession
    extra = spark.createDataFrame([(None, "stray", "x"), (900_001, None, None), (900_002, "", None), (900_003, "?!", "x"), (900_004, "long text " * 60_000, "x"),
                                   (900_004, "other text", "x")], "doc_id long, text string, source string")
    return docs.select("doc_id", "text", "source").unionByName(extra)


@pytest.fixture(scope="module")
def tables(spark):
    return odd(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("module, label, folds, out", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_held_out_accuracy_and_rows(tables, module, label, folds, out):
    import zlib

    docs, labels = tables
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == out)
        assert r.predicted == int(r.score >= (0.7 if label == "quality" else 0.5))
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([p == y for p, y in held]) >= 0.94


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_tables_and_no_labels(tables, module):
    docs, labels = tables
    assert module.classify(docs.where("false"), labels).count() == 0
    few = docs.where("doc_id >= 900001")
    assert module.classify(few, labels.where("false")).count() == few.count()


def test_accepted_keeps_columns_and_order_of_decision(tables):
    docs, labels = tables
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in quality.classify(docs, labels).where("predicted = 1 and doc_id is not null").collect())
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for lengths in ([1], [5], [3, 1, 6], [2] * 5):
        e, trans = rng.normal(size=sum(lengths)) * 3, rng.normal(size=(2, 2))
        first = np.zeros(sum(lengths), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        p, pairs = toxicity.marginals(e, first, trans)
        want, counts, at = [], np.zeros((2, 2)), 0
        for n in lengths:
            total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
            for path in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(e[at + i] for i in range(n) if path[i]) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
                total += w
                one += w * np.array(path)
                for a, b in itertools.pairwise(path):
                    two[a, b] += w
            want += list(one / total)
            counts += two / total
            at += n
        assert np.allclose(p, want) and np.allclose(pairs, counts)


def test_attention_gradient():
    rng = np.random.default_rng(2)
    model = quality.Model(5)
    x, bag, y = rng.normal(size=(7, 5)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, bag, 3)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in model.gradient(x, bag, y).items():
        flat = model.p[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_score_does_not_depend_on_the_batch():
    params = quality.Model(quality.GRAMS + len(quality.CLASSES) + 2).p
    column = ["a few words here", "", "LOUD!! " * 300, "x" * 5000]
    assert np.allclose(quality.score_texts(params, column), [quality.score_texts(params, [t])[0] for t in column])


def test_toxic_offsets():
    model = {"w": np.zeros(toxicity.SLOTS), "bias": -5.0, "trans": np.zeros((2, 2)), "cal": np.array([0.0, 1.0, 0.0])}
    model["w"][toxicity.features("scum")[0]] = 12.0
    text = "İ am é Scum scum, fine scum"
    p = toxicity._tag(model, [toxicity._words(text)])[0]
    assert toxicity._spans(text, p) == "7:16,23:27"
