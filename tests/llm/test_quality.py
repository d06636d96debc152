import random

import numpy as np
import pyarrow as pa

from readloom.llm import common, quality


def rows(rng, n):
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(5, 90))]
        kind = i % 5
        text = " ".join(words) + "."
        if kind == 0:
            text = rng.choice([text.upper(), " ".join([words[0]] * len(words)), "### ".join(words), " | ".join(words)])
        texts.append(text)
        labels.append(float(kind != 0))
    return texts, np.array(labels)


def features(texts):
    return quality.features(*common.flat(pa.array([t.encode() for t in texts], pa.large_binary())))


def test_held_out_accuracy():
    texts, labels = rows(random.Random(1), 800)
    model = quality.fit(features(texts), labels)
    texts, labels = rows(random.Random(2), 400)
    assert ((model.score(features(texts)) >= 0.7) == labels).mean() > 0.95


def test_interactions_are_learnt():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, 3))
    label = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, label)
    assert ((model.score(x) > 0.5) == label).mean() > 0.9
    assert (model.pairs[0][0], model.pairs[0][1]) == (1, 0)


def test_features_do_not_depend_on_neighbours():
    texts = ["", "One two, two!", "été été", " \n ", "A" * 50, "1 2 3"]
    together = features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(features([t])[0], together[i])
    assert not together[0].any()


def test_table_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "x y", 0.1), (2, "long " * 9000, 0.0)], "doc_id long, text string, quality double")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fitted(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.quality <= 1 for r in got)
    assert quality.score_quality(docs.limit(0), quality.fitted(docs.limit(0), labels.limit(0))).count() == 0
