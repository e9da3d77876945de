import numpy as np

from creditline.llm.toxicity import Model, features, fit, reject_toxic, score, train

LABELS = "doc_id bigint, toxic int, quality int, text string"


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    rows, toxic = [], {}
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ka", "lo", "mi", "ten"], 80), rng.choice(["ra", "so", "ti", "u"], 80), strict=True)]
        toxic[i] = int(rng.random() < 0.2)
        if toxic[i]:
            for _ in range(rng.integers(1, 6)):
                words[rng.integers(80)] = str(rng.choice(["Vile!", "nasty", f"grub{rng.integers(10**6)}"]))
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_held_out_accuracy_and_severity_order(spark, make):
    rows, toxic = corpus(900)
    labels = spark.createDataFrame([(i, t, None, "x") for i, t in toxic.items() if i < 600] + [(None, 1, 1, ""), (700, None, 1, ""), (5, 0, 0, "")], LABELS)
    got = {r.doc_id: r for r in score(make(rows), train(make(rows), labels)).collect()}
    held = [i for i in toxic if i >= 600]
    assert np.mean([got[i].toxic == bool(toxic[i]) for i in held]) > 0.97
    for r in got.values():
        assert 0 <= r.severity <= 3 and 0 <= r.grade <= 3 and r.toxic == (r.p_toxic >= 0.5)
    count = {i: sum(w in ("Vile!", "nasty") or w.startswith("grub") for w in t.split()) for i, t in rows}
    mean = [np.mean([got[i].severity for i in held if count[i] == c]) for c in (0, 1, 4)]
    assert mean[0] < mean[1] < mean[2]
    kept = reject_toxic(make(rows), labels)
    assert kept.columns == make(rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_fit_recovers_shared_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (4000, 3))
    s = counts @ np.array([1.5, 0.5, -1.0]) + rng.logistic(size=4000)
    grade = np.searchsorted([1.0, 2.5, 4.0], s)
    x = [np.repeat(np.arange(3), c) for c in counts]
    w, theta = fit(x, grade, 3)
    assert np.allclose(w, [1.5, 0.5, -1.0], atol=0.2) and np.allclose(theta, [1.0, 2.5, 4.0], atol=0.25)
    assert (np.diff(theta) > 0).all()


def test_long_clean_text_and_edge_rows(spark, make):
    model = Model({"vile": 9.0, "^gru": 9.0}, np.array([4.0, 20.0, 30.0]))
    rows = [(1, None), (2, ""), (3, "clean " * 200_000), (4, "clean " * 200_000 + "VILE"), (5, "grubby"), (5, "grubby"), (None, "gru vile")]
    got = score(make(rows), model).collect()
    assert sorted((r.doc_id, r.toxic) for r in got if r.doc_id) == [(1, False), (2, False), (3, False), (4, True), (5, True), (5, True)]
    assert [r.toxic for r in got if r.doc_id is None] == [True]
    assert features("grubby") == ["grubby", "^gru", "^grub", "^grubb"]


def test_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], LABELS)
    docs = make([(1, "nasty words"), (2, None)])
    assert [r.toxic for r in score(docs, train(docs, none)).collect()] == [False, False]
    one = spark.createDataFrame([(1, 1, 1, "")], LABELS)
    assert reject_toxic(docs, one).count() == 2
    assert reject_toxic(make([]), one).collect() == []


def test_an_id_of_many_texts_is_one_example(spark, make):
    rows, toxic = corpus(300)
    labels = spark.createDataFrame([(i, t, None, "x") for i, t in toxic.items()], LABELS)
    texts = dict(rows)
    more = [(i, "zz " + texts[i]) for i in range(3) for _ in range(400)]  # later in order than the texts themselves
    a, b = train(make(rows), labels), train(make(rows + more), labels)
    assert a.weights == b.weights and (a.thresholds == b.thresholds).all()
