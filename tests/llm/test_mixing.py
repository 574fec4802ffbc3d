"""Targets by rule, topics, and margins over tables that no target was written for."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from domicilia.llm.mixing import TARGETS, Mixing, Tempered, TopicModel, cluster, described, rake, word_features
from domicilia.llm.words import Words


@pytest.fixture(scope="module")
def corpus(spark):
    """Two vocabularies, and a source that no list names with a third of all tokens."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        kind = k % 3 == 0
        words = [f"{'north' if kind else 'south'}{i}" for i in rng.zipf(1.6, 60) % 50]
        source = "unlisted" if k % 3 == 1 else f"s{k % 7}"
        rows.append((k, " ".join(words), source, "en" if k % 4 else None, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind boolean").repartition(5)


def test_margins_of_sources_found_by_rule(corpus):
    mixing = Mixing({"source": Tempered(power=0.5), "lang": {"en": 3.0, "xx": 1.0}, "topic": TARGETS["topic"]})
    got = mixing.run(corpus, model=TopicModel(clusters=2, sample=200)).toPandas()
    got["w"] = got.n_tokens * got.factor
    total = got.n_tokens.sum()
    goal = np.sqrt(got.groupby("source").n_tokens.sum())
    assert np.allclose(got.groupby("source").w.sum() / total, goal / goal.sum(), atol=1e-6)
    assert got[got.lang.isna()].w.sum() / total == pytest.approx(got[got.lang.isna()].n_tokens.sum() / total)
    topics = got.groupby("topic").w.sum() / total
    assert len(topics) == 2 and np.allclose(topics, 0.5, atol=1e-6)
    assert got[got.sampled].n_tokens.sum() / total == pytest.approx(0.9, abs=0.05)
    # Weights of drawn documents give the margins again, up to chance.
    assert got.groupby("source").apply(lambda g: (g.n_tokens * g.weight).sum(), include_groups=False).sum() == pytest.approx(total, rel=0.1)


@pytest.mark.parametrize("few", [20_000, 2])
def test_rule_with_a_rest_class(corpus, monkeypatch, few):
    monkeypatch.setattr("domicilia.llm.mixing._FEW_GROUPS", few)
    mixing = Mixing({"source": Tempered(power=0.5, most=2)})
    rows = corpus.withColumn("n_tokens", F.lit(10))
    got = mixing.weighted(rows).toPandas()
    sizes = got.groupby("source").size().sort_values(ascending=False, kind="stable")
    named = sorted(sizes.index, key=lambda s: (-sizes[s], s))[:2]
    tokens = [*(10.0 * sizes[s] for s in named), 10.0 * (600 - sizes[named].sum())]
    goal = np.sqrt(tokens) / np.sqrt(tokens).sum()
    own = [got[got.source == s].factor.sum() / 600 for s in named] + [got[~got.source.isin(named)].factor.sum() / 600]
    assert np.allclose(own, goal, atol=1e-6)


def test_raking_with_a_stated_rest():
    table = np.random.default_rng(0).integers(1, 50, (3, 4)).astype(float)
    fitted = table * rake(table, [np.array([1.0, 2, 5]), np.array([1.0, 1, 1])])
    assert np.allclose(fitted.sum(1) / fitted.sum(), np.array([1, 2, 5]) / 8)


def test_topics_follow_words_and_not_the_layout(corpus):
    model = TopicModel(clusters=2, sample=150)
    one, other = model.fit(corpus), model.fit(corpus.coalesce(1))
    assert np.array_equal(one.centres, other.centres) and np.array_equal(one.weights, other.weights)
    found = described(corpus, one).toPandas()
    assert found.groupby("kind").topic.nunique().tolist() == [1, 1] and found.topic.nunique() == 2
    assert (found.n_tokens == 60).all()


def test_topics_of_hard_texts(spark):
    texts = pa.array(["", None, " \n", "word", "word word", "x" * 100_000, "é ü"])
    features = word_features(Words.of(texts), 16)
    assert features.shape == (7, 16) and features.sum(1).tolist() == [0, 0, 0, 1, 2, 1, 2]
    topics = cluster(features, 3, 1)
    names, counts = topics.of(texts)
    assert names[:3] == [None] * 3 and None not in names[3:] and names[3] == names[4] and counts.tolist() == [0, 0, 0, 1, 2, 1, 2]
    nothing = cluster(np.zeros((0, 16), np.float32), 3, 1)
    assert nothing.of(pa.array(["word", None]))[0] == ["topic0", None]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert len(TopicModel().fit(empty).centres) == 1


def test_names_that_clash_are_refused(corpus):
    with pytest.raises(ValueError, match="replaced"):
        Mixing({"source": Tempered()}).weighted(corpus.withColumns({"n_tokens": F.lit(1), "u": F.lit(1)}))


def test_every_text_fits_the_topics(spark):
    """More texts than a sample would hold: all count in the weights, and rare ones make a topic of their own."""
    rows = spark.range(9000).selectExpr("id AS doc_id", "if(id < 8995, concat_ws(' ', 'common', id % 7), 'quite other words') AS text").repartition(3)
    topics = TopicModel(clusters=2).fit(rows)
    shared = word_features(Words.of(pa.array(["common"])), 512)[0].argmax()
    assert topics.weights[shared] == pytest.approx(np.log(9001 / 8996), rel=1e-3)
    found = described(rows, topics).groupBy("topic").count().toPandas().set_index("topic")["count"]
    assert found.sum() == 9000 and len(found) == 2
