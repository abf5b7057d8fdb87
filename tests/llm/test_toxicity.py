import random

import numpy as np

from pharmalith.llm import toxicity

BAD, GOOD = ["zorg", "blarg", "murk", "flub"], [f"w{k}" for k in range(300)]


def corpus(spark, n, seed, noise=0.03):
    rng, docs, labels, truth = random.Random(seed), [], [], {}
    for k in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 7) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic != (rng.random() < noise))))
        truth[k] = toxic
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, _ = corpus(spark, 600, 1)
    model = toxicity.fit(docs, labels)
    other, _, truth = corpus(spark, 400, 2)
    got = {r.id: r.severity >= toxicity.REJECT_FROM for r in toxicity.score(other, model).collect()}
    assert sum(got[k] == truth[k] for k in truth) / len(truth) > 0.98
    assert (np.diff(model.thresholds) > 0).all()


def test_severity_grows_with_abuse(spark):
    docs, labels, _ = corpus(spark, 600, 1)
    model = toxicity.fit(docs, labels)
    texts = ["w1 w2 w3", "w1 zorg w2", "w1 zorg w2 blarg", "zorg blarg murk flub zorg"]
    got = {r.id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k].severity for k in range(4)] == sorted(got[k].severity for k in range(4)) and got[0].severity < 0.5 < got[3].severity


def test_held_out_on_the_table(spark):
    """Fitted on half of the labelled rows, it tells the other half's apart about as well as their labels allow."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), toxicity.F.col("id") == labels.doc_id).collect()
    assert sum((r.severity >= 0.5) == (r.toxic == 1) for r in held) / len(held) > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ok " * 200_000, "x"), (3, "ok", "y"), (None, "ok", "z")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.toxic for r in toxicity.op7(spark, docs, labels).collect()] == [False] * 5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert toxicity.op7(spark, docs.limit(0), labels.limit(0)).collect() == []


def test_the_sample_is_bounded_and_repeats(spark):
    docs, labels, _ = corpus(spark, 300, 5)
    assert toxicity._sample(docs, labels, 50, "doc_id", "text", "toxic").count() == 50
    assert len(toxicity.fit(docs, labels, most=3).words) == 3
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(a.weights, b.weights) and (a.words == b.words).all()


def test_features_are_chosen_as_numpy_would(spark):
    docs, labels, _ = corpus(spark, 300, 7)
    sample = toxicity._sample(docs, labels, 300, "doc_id", "text", "toxic")
    rows = sample.collect()
    n, toxic = len(rows), sum(r.toxic for r in rows)
    got = {r.word: (r.df, r.df_toxic, r.ratio) for r in toxicity._frequencies(sample).withColumn("ratio", toxicity._ratio(n, toxic)).collect()}
    df = {}
    for r in rows:
        for w in np.frombuffer(r.words, "<i8").tolist():
            a, b = df.get(w, (0, 0))
            df[w] = (a + 1, b + r.toxic)
    assert {k: v[:2] for k, v in got.items()} == df
    want, _ = toxicity._told_apart(*(np.array([v[k] for v in df.values()], dtype=float) for k in (0, 1)), n, toxic)
    assert np.allclose([got[k][2] for k in df], want)


def test_severity_orders_held_out_rows(spark):
    """On rows that no feature was chosen on, more abuse gives a higher expected severity."""
    docs, labels, _ = corpus(spark, 800, 11)
    model, rng = toxicity.fit(docs, labels), random.Random(12)
    rows = [(k, " ".join([rng.choice(GOOD) for _ in range(40)] + [rng.choice(BAD) for _ in range(k % 6)])) for k in range(300)]
    got = {r.id: r.severity for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    mean = [np.mean([got[k] for k in got if k % 6 == b]) for b in range(6)]
    assert mean == sorted(mean) and mean[0] < 0.2
