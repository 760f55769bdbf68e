"""Ordinal regression: convergence, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiospark.llm import ordinal, quality, toxicity

rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def text(toxic, low):
    words = [rng.choice(VOCAB) for _ in range(rng.randint(20, 120))]
    if toxic:
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(["vile", "scumXY".lower() + str(rng.randint(0, 99))])
    if low:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = [], []
    for i in range(900):
        toxic, low = rng.random() < 0.2, rng.random() < 0.2
        rows.append((i, text(toxic, low)))
        if i < 600:
            labels.append((i, int(not low), int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "w1 w2"), (5, rows[5][1])]
    labels += [(None, 1, 0), (7, None, None), (5, 1, 0), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"s": F.lit(1), "score": F.lit("x")})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(data):
    docs, labels = data
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: "vile" in r.text.lower() or "scum" in r.text.lower() for r in docs.filter("doc_id BETWEEN 600 AND 899").collect()}
    right = [r.toxic == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.expected_severity <= 2 for r in got)
    assert not any(r.toxic for r in got if r.doc_id in (2000, 2001))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    again = toxicity.toxicity(docs.repartition(7), labels)
    key = lambda rows: sorted((str(r.doc_id), round(r.p_toxic, 9)) for r in rows)
    assert key(again.collect()) == key(got)


def test_quality(data):
    docs, labels = data
    got = quality.quality(docs, labels).collect()
    truth = {r.doc_id: "!!" not in r.text for r in docs.filter("doc_id BETWEEN 600 AND 899").collect()}
    assert np.mean([r.kept == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.95
    assert all(r.p_good >= r.p_best and abs(r.p_good + r.p_best - r.expected_grade) < 1e-9 for r in got)


def test_without_labels_or_documents(data):
    docs, labels = data
    assert not any(r.toxic for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    one_grade = labels.filter("toxic = 0")
    assert not any(r.toxic for r in toxicity.toxicity(docs, one_grade).collect())


def sample(n=500, names=60, seed=1):
    r = np.random.default_rng(seed)
    x = [np.sort(r.choice(names, 8, replace=False)) for _ in range(n)]
    weight = np.zeros(names)
    weight[:6] = 2.0
    f = np.array([weight[i].sum() for i in x]) + r.logistic(size=n)
    return x, np.digitize(f, [0.5, 2.0, 4.0])


def test_fit_orders_thresholds_and_lowers_the_loss():
    x, y = sample()
    m = ordinal.fit(x, y, np.ones(500), 4)
    table = m.table()
    assert list(m.thresholds) == sorted(m.thresholds) and table[:6].min() > 0.8
    tails = m.tails(np.array([table[i].sum() for i in x]))
    assert (tails[:, :-1] >= tails[:, 1:]).all() and np.corrcoef(tails.sum(axis=1), y)[0, 1] > 0.6


def test_fit_reaches_the_optimum_of_the_penalised_loss():
    """No step of any weight or threshold lowers a loss that is written down independently, nor does a plain search from elsewhere."""
    x, y = sample(300, 20, 4)
    rows, l1 = np.random.default_rng(0).uniform(0.5, 2, 300), 5e-3
    dense = np.zeros((300, 20))
    for i, own in enumerate(x):
        dense[i, own] = 1

    def plain(w, t):
        below = lambda z: 1 / (1 + np.exp(-z))
        p = [below(t[k] - dense[i] @ w) - (below(t[k - 1] - dense[i] @ w) if k else 0) if k < len(t) else 1 - below(t[k - 1] - dense[i] @ w) for i, k in enumerate(y)]
        return -(rows * np.log(p)).sum() / rows.sum() + l1 * np.abs(w).sum()

    m = ordinal.fit(x, y, rows, 4, l1=l1, close=1e-4, choices=60)
    w, t = m.table()[:20], np.array(m.thresholds)
    best = plain(w, t)
    assert abs(best - ordinal.loss(m, x, y, rows, l1)) < 1e-9
    for k in range(20):
        for d in (1e-2, -1e-2, 1e-1, -1e-1):
            assert plain(w + d * (np.arange(20) == k), t) > best - 1e-7
    for k in range(3):
        for d in (1e-2, -1e-2):
            assert plain(w, t + d * (np.arange(3) == k)) > best - 1e-7
    v, u, step, low = np.zeros(20), np.array([0.0, 1.0, 2.0]), 0.5, plain(np.zeros(20), np.array([0.0, 1.0, 2.0]))
    for _ in range(30):  # a coordinate search from zero, which knows no gradients
        before = low
        for k in range(23):
            for d in (step, -step):
                a, b = v + d * (np.arange(20) == k), u + d * (np.arange(20, 23) == k)
                if (np.diff(b) > 0).all() and (new := plain(a, b)) < low:
                    v, u, low = a, b, new
        step = step / 2 if low == before else step
    assert best <= low + 1e-6 and low - best < 5e-3


def test_features_against_plain_python():
    import pyarrow as pa

    texts = ["Hello, WORLD!! hello", None, "", "  --- a-b\tc ", "ABC def's... \x85 Ünï", "x" * 600_000 + " y", "hello. HELLO hello"]
    got = {}
    for first, rows, row, bucket in ordinal.text_features(pa.array(texts)):
        for i in range(rows):
            got[first + i] = set(bucket[row == i].tolist())
    assert set(got) == set(range(len(texts)))
    symbols = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def kinds(text):
        """Names of the features of words."""
        found = set()
        for w in (text or "").encode().split():
            core = w.strip(symbols.encode())
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in core)
            tail = w[len(w.rstrip(symbols.encode())) :] if core else w
            found |= {(0, low)} if core else set()
            found |= {(k, low[:n]) for k, n in enumerate((4, 5, 6), 1) if len(core) >= n}
            found |= {(4, bytes(tail[-3:]))} if tail else set()
            found |= {(5, b"")} if len(core) > 1 and 65 <= core[0] <= 90 and not any(97 <= c <= 122 for c in core) else set()
        return found

    names = {}
    for i, text in enumerate(texts):
        names[i] = kinds(text)
    for i in names:  # as many buckets as names and 3 to 7 of the text's shape
        assert len(names[i]) + 3 <= len(got[i]) <= len(names[i]) + 7
        for j in names:
            assert len(got[i] & got[j]) >= len(names[i] & names[j])
    assert got[1] == got[2]


def test_graded_ratings_and_confusion(spark):
    """Held-out documents with three known grades: most are on the diagonal, hardly any two grades off."""
    r = random.Random(8)

    def made(grade):
        words = [r.choice(VOCAB) for _ in range(60)]
        for _ in range((0, 4, 14)[grade]):
            words[r.randrange(60)] = "vile" + str(r.randrange(5))
        return " ".join(words)

    grades = [r.choice((0, 0, 1, 2)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, made(g)) for i, g in enumerate(grades)], "doc_id long, text string")
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades[:1000])], "doc_id long, rating int")
    for f, column in ((toxicity.toxicity, "severity"), (quality.quality, "grade")):
        got = {row.doc_id: row[column] for row in f(docs, rated, grade=F.col("rating")).collect()}
        confusion = np.zeros((3, 3), int)
        for i in range(1000, 1500):
            confusion[grades[i], got[i]] += 1
        assert confusion.trace() > 0.8 * confusion.sum() and confusion[0, 2] + confusion[2, 0] <= 2


def test_grades_by_evidence_lie_on_one_scale(data):
    docs, labels = data
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r.severity > 0]
    assert {r.severity for r in got} <= {1, 2} and all(r.toxic for r in got)
    f, y = [np.array([0, 1])] * 30 + [np.array([0, 2])] * 30 + [np.array([0, 2, 3])] * 30, np.repeat([0, 1, 1], 30)
    grades = ordinal.graded(f, y, np.ones(90), np.arange(90) % 2)
    assert (grades[:30] == 0).all() and set(grades[30:]) <= {1, 2}


def test_empty_null_and_long_texts_of_quality(data):
    docs, labels = data
    spark = docs.sparkSession
    rows = [(1, None), (2, ""), (3, " "), (4, "w1 " * 200_000), (5, "w2" * 500_000), (None, "w1"), (6, "w1"), (6, "w1")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "tails": F.lit("x"), "_i": F.lit(0), "_g": F.lit(0)})
    for f in (quality.quality, toxicity.toxicity):
        got = f(odd.unionByName(docs, allowMissingColumns=True), labels.filter("doc_id > 6")).filter("doc_id < 7 OR doc_id IS NULL").collect()
        p = [tuple(r)[3] for r in got]
        assert all(0 <= x <= 1 for x in p)
    assert quality.quality(odd.limit(0), labels).count() == 0
