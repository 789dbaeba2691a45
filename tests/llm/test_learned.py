"""Quality and language against plain rules, and the cases that tables may hold."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalog.llm import language, quality


def ftrl(rows, labels):
    """Follow the regularised leader, feature by feature."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for row, y in zip(rows, labels, strict=True):
            x = {}
            for f in row:
                x[f] = x.get(f, 0) + 1 / math.sqrt(max(1, len(row)))
            x[quality.SPACE] = 1.0
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_fit_equals_the_plain_updates():
    rng = random.Random(2)
    rows = [np.array([rng.randrange(30) for _ in range(rng.randrange(0, 12))], np.int64) for _ in range(80)]
    labels = np.array([float(len(r) and r.min() < 5) for r in rows])
    got, want = quality.fit(rows, labels), ftrl([r.tolist() for r in rows], labels.tolist())
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    assert np.flatnonzero(got).tolist() == sorted(i for i, w in want.items() if w)


TEXTS = ["Good words here, good words there.", "BUY!!! NOW!!! 1234", "", None, "one", "long words " * 50_000, "Good words here, good words there."]


def test_scores_are_sparse_dot_products(docs):
    weights = np.random.default_rng(1).normal(size=quality.SPACE + 1)
    out = {r.doc_id: r for r in quality.scored(docs([(i, t, None) for i, t in enumerate(TEXTS)]), weights).collect()}
    for i, t in enumerate(TEXTS):
        values, counts = quality.features(pa.array([t], pa.string()))
        total = sum(weights[v] for v in values.tolist()) / math.sqrt(max(1, int(counts[0]))) + weights[quality.SPACE]
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))
        assert abs(out[i].score - want) < 1e-7 and out[i].predicted == int(out[i].score >= 0.5)
    assert out[2].score == out[3].score and out[0].score == out[6].score


def test_quality_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (6, 7)], "doc_id bigint, quality int")
    rows = docs([(i, t, None) for i, t in enumerate(TEXTS)] + [(0, "again", None), (None, "no id", None)])
    out = quality.scored(rows, quality.train(rows, labels, F.lit(True))).collect()
    assert len(out) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in out)
    empty = quality.train(docs([]), labels, F.lit(True))
    assert not empty.any() and quality.scored(docs([]), empty).count() == 0
    assert {r.score for r in quality.scored(rows, quality.train(rows, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(0, 6, 4)
        scores = rng.normal(scale=6, size=(int(sizes.sum()), 3)).astype(np.float32)
        path = language.viterbi(scores, sizes, 4.0)
        at = 0
        for n in sizes.tolist():
            part = scores[at : at + n].astype(float)
            value = lambda p: sum(part[k, s] for k, s in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
            if n:
                assert abs(value(path[at : at + n].tolist()) - max(value(p) for p in itertools.product(range(3), repeat=n))) < 1e-4
            at += n


WORDS = {"aa": "the house and this river that people were", "bb": "хорошо дом река люди были этот очень", "cc": "la maison et cette rivière où des gens étaient"}


def corpus():
    rng, rows = random.Random(6), []
    for i in range(300):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 40))), lang))
    return rows


def test_language_of_odd_texts(spark, docs):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, la, 1) for i, t, la in rows] + [(900, None, "aa", 1), (901, "text", None, 1), (None, "x", "aa", 1)], "doc_id bigint, text string, lang string, doc int")
    model = language.train(frame, F.col("doc_id") % 4 != 2)
    mixed = "the house and this river that people were " * 9 + "хорошо дом река люди были этот очень " * 9 + "la maison et cette rivière où des gens étaient " * 9
    odd = {5000: None, 5001: "", 5002: "123 !! 4", 5003: "中文字", 5004: mixed, 5005: "дом " * 30_000, 5006: "the house", 5007: "the house"}
    test = spark.createDataFrame([*rows, *((i, t, "zz") for i, t in odd.items()), (0, "дом река", "aa")], "doc_id bigint, text string, lang string")
    out = language.identified(test, model, spans=True).collect()
    got = {r.doc_id: r for r in out if r.doc_id}
    assert len(out) == len(rows) + len(odd) + 1
    assert all(got[i].lang_pred == la for i, _, la in rows if i and i % 4 == 2)
    assert [got[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3 and {got[i].score for i in (5000, 5001, 5002, 5003)} == {0.0}
    assert [s.lang for s in got[5004].spans] == ["aa", "bb", "cc"] and got[5004].score < 0.5
    assert got[5005].lang_pred == "bb" and got[5006].score == got[5007].score
    kept = {r.doc_id for r in language.drop_unidentified(test, model).collect()}
    assert kept == {i for i, _, _ in rows} | {5004, 5005, 5006, 5007}
    nothing = language.train(frame.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identified(test, nothing).collect()} == {"und"}
    assert language.identified(test.limit(0), model).count() == 0 and language.drop_unidentified(test.limit(0), model).columns == test.columns
