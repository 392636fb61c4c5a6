import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality as Q
from skein.llm import toxicity as X
from skein.llm import trees
from skein.llm.labelled import held_out, sample

CLEAN = "the quick brown fox jumps over a lazy dog while seven small birds sing in old trees near our calm river and people walk home".split()
BAD = ["blorkhead", "snargfool", "grubwitted", "vexmuck"]


def prose(r, n):
    return " ".join(r.choice(CLEAN) for _ in range(n))


def toxic_corpus():
    r, rows = random.Random(4), []
    for i in range(400):
        words = prose(r, r.randint(20, 200)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 60):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def toxic(spark, make):
    rows = toxic_corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None), (None, 1)], "doc_id long, toxic int")
    return X.fit_toxicity(labels, make([r[:2] for r in rows])), rows


def test_toxicity_on_held_out_rows(make, toxic):
    model, rows = toxic
    got = {r["doc_id"]: r for r in X.score_toxicity(make([r[:2] for r in rows]), model).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert 80 < len(held) < 200
    assert np.mean([got[i]["predicted"] == y for i, _, y in held]) >= 0.95


def test_misspellings_and_long_texts(make, toxic):
    model, _ = toxic
    r = random.Random(9)
    long = prose(r, 20_000).split()
    long[13_000] = "blorkhead"
    rows = [(0, prose(r, 30)), (1, prose(r, 10) + " blorkheads " + prose(r, 10)), (2, " ".join(long)), (3, prose(r, 20_000)), (4, prose(r, 10) + " snarggfool " + prose(r, 10))]
    score = {x["doc_id"]: x["score"] for x in X.score_toxicity(make(rows), model).collect()}
    assert min(score[1], score[2], score[4]) > 0.5 > max(score[0], score[3])


def test_toxicity_odd_rows(spark, odd, none, toxic):
    model, _ = toxic
    got = X.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 5)}) == 1
    assert X.score_toxicity(none, model).collect() == []
    empty = X.fit_toxicity(spark.createDataFrame([], "doc_id long, toxic int"), odd)
    assert {r["score"] for r in X.score_toxicity(odd, empty).collect()} == {0.5}


def test_grams_don_t_cross_texts():
    a = np.frombuffer(b"abcdef ghi", np.uint8)
    both = np.concatenate([a, a])
    b1, w1, _ = X.word_grams(a, np.array([0, 10]))
    b2, w2, first = X.word_grams(both, np.array([0, 10, 20]))
    assert first.tolist() == [0, 2, 4]
    assert sorted(b2[w2 < 2]) == sorted(b2[w2 >= 2]) == sorted(b1)


def junk(r, n):
    return " ".join(r.choice(CLEAN) + r.choice(["***", "$$$", "!!", " |"]) for _ in range(n))


def quality_corpus():
    r = random.Random(5)
    return [(i, junk(r, r.randint(5, 80)) if i % 4 == 0 else prose(r, r.randint(5, 80)), int(i % 4 != 0)) for i in range(400)]


def test_quality_on_held_out_rows(spark, make, odd, none):
    rows = quality_corpus()
    docs = make([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 0)], "doc_id long, quality int")
    forest = Q.fit_quality(labels, docs)
    got = {r["doc_id"]: r for r in Q.score_quality(docs, forest).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == y for i, _, y in held]) >= 0.97
    kept = Q.keep_good(docs, forest)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    odd_scores = Q.score_quality(odd, forest).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r["score"] <= 1 for r in odd_scores) and all(r["held_out"] for r in odd_scores if r["doc_id"] is None)
    assert Q.score_quality(none, forest).collect() == [] and Q.keep_good(none, forest).count() == 0
    one = Q.fit_quality(labels.where("quality = 1"), docs)
    assert len({r["score"] for r in Q.score_quality(docs, one).collect()}) == 1


def test_statistics_are_of_single_texts():
    texts = [b"One two, TWO 3!\nOne two", b"", b"x\n\nx", "é é".encode()]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = Q.statistics(data, offs)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], Q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
    at = dict(zip(Q.FEATURES, whole[0]))
    assert np.isclose(at["words"], np.log1p(6)) and np.isclose(at["distinct_words"], 5 / 6) and np.isclose(at["upper"], 5 / 23) and np.isclose(at["lines"], np.log1p(2))


def test_traversal_against_a_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.fit(x, y, trees=20, depth=3)
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        out = forest.start
        for t in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.cut[t, node])
            out += forest.leaf[t, node - forest.feature.shape[1]]
        return out

    assert np.allclose(forest.margin(x[:50]), [walk(row) for row in x[:50]])


def test_sample_is_bounded_and_leaves_the_fold_out(spark, make):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0)], "doc_id long, y int")
    got = sample(labels, make([(i, str(i)) for i in range(300)]), "y", 3, 1, (20, 30)).withColumn("h", held_out("doc_id", 3, 1)).collect()
    assert [sum(r["label"] == k for r in got) for k in (0, 1)] == [20, 30] and not any(r["h"] for r in got)


def test_fold(spark):
    from zlib import crc32

    got = {r["i"]: r["h"] for r in spark.range(50).select(F.col("id").alias("i"), held_out("id", 4, 2).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 4 == 2 for i in range(50)}
