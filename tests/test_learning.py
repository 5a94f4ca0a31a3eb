import numpy as np

from stemline.operators import learning, scoring


def test_fitted_choice_finds_planted_weights(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(800):
        x = rng.normal(size=(rng.integers(1, 5), 2)) * [2.0, 0.5] + [1.0, 3.0]
        e = np.exp(0.5 + 1.2 * (x[:, 0] - 1) / 2 - 0.8 * (x[:, 1] - 3) / 0.5)
        pick = rng.choice(len(x) + 1, p=np.r_[1.0, e] / (1 + e.sum()))
        rows += [("m", g, int(k + 1 == pick), float(a), float(b)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "dataset string, d2_id long, chosen int, f double, g double")
    model = learning.fit_choice(df, ["f", "g"])
    assert np.abs(model["weights"] - [0.5, 1.2, -0.8]).max() < 0.25
    part = learning.fit_choice(df, ["f", "g"], most=400)
    assert not np.allclose(part["weights"], model["weights"])
    u = df.select(learning.utility(model).alias("u"), "f", "g").first()
    want = model["weights"] @ [1, (u.f - model["mean"][0]) / model["scale"][0], (u.g - model["mean"][1]) / model["scale"][1]]
    assert abs(u.u - want) < 1e-9
    assert learning.fit_choice(df.limit(0), ["f", "g"])["weights"].tolist() == [0, 0, 0]


def test_fitted_head_is_better_on_other_rows_and_bounded(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    target = np.tanh(x @ rng.normal(size=(12, 3)) / 3)
    start = learning.start_head(12)
    head = learning.fit_head(x[:400], target[:400], start, keep=0.03, rate=3e-3, epochs=400)
    error = lambda h: np.linalg.norm(learning.head_output(x[400:], *h)[0] - target[400:], axis=1).mean()
    assert error(head) < 0.6 * error(start)
    held = learning.fit_head(x[:400], target[:400], start, keep=30.0, rate=3e-3, epochs=100)
    assert np.linalg.norm(learning.head_output(x, *held)[0] - learning.head_output(x, *start)[0], axis=1).mean() < 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = learning.bounded_offset(df, "v", *head).orderBy("id").toPandas()
    assert np.allclose(got[["dz", "dy", "dx"]].to_numpy(), learning.head_output(x, *head)[0]) and (np.linalg.norm(got[["dz", "dy", "dx"]], axis=1) < 2).all()


def test_gradient_of_the_head():
    rng = np.random.default_rng(1)
    x, y, head = rng.normal(size=(5, 4)), rng.normal(size=(5, 3)), learning.start_head(4, 3)
    loss = lambda h: (lambda d: np.where(np.abs(d) < 0.5, d * d / 1.0, np.abs(d) - 0.25).mean())(learning.head_output(x, *h)[0] - y)
    small = learning.fit_head(x, y, head, keep=0.0, rate=1e-6, epochs=1)
    for k in range(2):  # the first step of Adam goes against the sign of the gradient
        for at in np.ndindex(head[k].shape):
            up = [p.copy() for p in head]
            up[k][at] += 1e-5
            slope = (loss(up) - loss(head)) / 1e-5
            if abs(slope) > 1e-4:
                assert np.sign(small[k][at] - head[k][at]) == -np.sign(slope)


def test_curve_over_bucket_borders(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s), str(v)) for s, v in zip(np.r_[rng.random(300), [0.5] * 9, 5e3, -5e3, 1e9], rng.choice(["tp", "fp", "ignored"], 312))] + [(None, "tp"), (float("nan"), "fp")]
    got = {r.score: (r.tp, r.fp) for r in scoring.pr_curve(spark.createDataFrame(rows, "score double, label string")).collect()}
    known = [r for r in rows if r[0] is not None and r[0] == r[0] and r[1] != "ignored"]
    assert got == {s: tuple(sum(r[0] >= s and r[1] == v for r in known) for v in ("tp", "fp")) for s in {r[0] for r in known}}
    none = scoring.ranking_quality(spark.createDataFrame(rows, "score double, label string").where("label = 'tp'")).first()
    assert none.n_fp == 0 and none.roc_auc is None
