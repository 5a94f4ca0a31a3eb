"""Learned parts: fork classifiers, folds, training events, and a bounded correction of positions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fork_classifier(train: DataFrame, features: list[str], label: str = "is_tp", reg: float = 0.01):
    """A fitted pipeline: median for missing features, standard scale, balanced logistic regression. Features without any value take no part."""
    known = train.agg(*[F.count(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]).first()  # one row
    features = [f for f in features if known[f]]
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two rows
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts.get(1, 1))).otherwise(total / (2 * counts.get(0, 1)))
    filled = [f"{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("weight", weight))


def probability(model, rows: DataFrame, name: str = "prob") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: list[str], label: str = "is_tp", fold: str = "fold", k: int = 5, reg: float = 0.01) -> DataFrame:
    """rows with prob: each fold (0 to k - 1) is scored by a classifier that is fitted to the labelled rows of the others."""
    parts = []
    for f in range(k):
        model = fork_classifier(rows.where(F.col(label).isNotNull() & (F.col(fold) != f)), features, label, reg)
        parts.append(probability(model, rows.where(F.col(fold) == f)).select(*rows.columns, "prob"))
    return reduce(DataFrame.unionByName, parts)


def choice_design(rows: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Standardised features, the group of each row, what each row's choice is, and the mean and scale that were used."""
    x = rows[features].to_numpy(float)
    if not len(x):
        return x, np.zeros(0, np.int64), np.zeros(0), np.stack([np.zeros(len(features)), np.zeros(len(features)), np.ones(len(features))])
    centre = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), centre, x)
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    group = rows[["dataset", "d2_id"]].apply(tuple, axis=1).factorize()[0]
    return (x - mean) / scale, group, rows.chosen.to_numpy(float), np.stack([centre, mean, scale])


def fit_choice(rows: DataFrame, features: list[str], most: int = 200_000, ridge: float = 1e-2, rounds: int = 40) -> dict:
    """The weights of a conditional choice among the candidates of one daughter, none being a choice too, by Newton steps.

    rows(dataset, d2_id, chosen 0/1, features..). It is fitted to a sample of whole groups of about most rows, which are the
    first in the order of a hash; fewer rows are taken whole. The intercept is the value of any candidate over none.
    """
    share = F.lit(most) / F.greatest(F.lit(1), F.lit(rows.count()))
    position = (F.xxhash64("dataset", "d2_id").cast("double") + 2.0**63) / 2.0**64
    sample = rows.where(position < share).select("dataset", "d2_id", "chosen", *features).toPandas()
    x, group, chosen, used = choice_design(sample.sort_values(["dataset", "d2_id", *features]), features)
    x = np.c_[np.ones(len(x)), x]
    w, n = np.zeros(x.shape[1]), int(group.max()) + 1 if len(group) else 0
    for _ in range(rounds):
        e = np.exp(np.clip(x @ w, -30, 30))
        p = e / (1 + np.bincount(group, e, minlength=n))[group] if n else e
        mean = np.zeros((n, x.shape[1]))
        np.add.at(mean, group, p[:, None] * x)
        grad = x.T @ (chosen - p) - ridge * w
        hess = (x * p[:, None]).T @ x - mean.T @ mean + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return {"features": features, "weights": w, "centre": used[0], "mean": used[1], "scale": used[2]}


def utility(model: dict):
    """The utility of a candidate under a fitted choice, as a column."""
    out = F.lit(float(model["weights"][0]))
    for f, w, c, m, s in zip(model["features"], model["weights"][1:], model["centre"], model["mean"], model["scale"]):
        value = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(float(c))), F.lit(float(c)))
        out = out + float(w) * (value - float(m)) / float(s)
    return out


def start_head(width: int, units: int = 32, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of an unfitted head, biases in the last rows."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width + 1, units)) / np.sqrt(width), rng.normal(size=(units + 1, 3)) / np.sqrt(units)


def head_output(x: np.ndarray, hidden: np.ndarray, out: np.ndarray, most: float = 2.0) -> tuple[np.ndarray, ...]:
    """(bounded offset, raw one, activation, pre-activation) of feature rows."""
    h = x @ hidden[:-1] + hidden[-1]
    a = h / (1 + np.exp(-h))
    raw = a @ out[:-1] + out[-1]
    return most * raw / (1 + np.linalg.norm(raw, axis=1, keepdims=True)), raw, a, h


def fit_head(x: np.ndarray, target: np.ndarray, head: tuple[np.ndarray, np.ndarray], keep: float = 0.3, rate: float = 1e-3, epochs: int = 300, beta: float = 0.5, most: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """A head fine-tuned to targets (smooth L1), held near the outputs of the one given; full batches, Adam."""
    teacher = head_output(x, *head, most)[0]
    params = [p.copy() for p in head]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, epochs + 1):
        pred, raw, a, h = head_output(x, *params, most)
        grad = np.clip((pred - target) / beta, -1, 1) / pred.size + keep * 2 * (pred - teacher) / len(x)
        norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        grad = most * (grad / (1 + norm) - raw * (raw * grad).sum(axis=1, keepdims=True) / (norm * (1 + norm) ** 2))
        g_out = np.r_[a.T @ grad, grad.sum(axis=0, keepdims=True)]
        sig = 1 / (1 + np.exp(-h))
        back = (grad @ params[1][:-1].T) * (sig * (1 + h * (1 - sig)))
        g_hidden = np.r_[x.T @ back, back.sum(axis=0, keepdims=True)]
        for i, g in enumerate((g_hidden, g_out)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return params[0], params[1]


def labelled_sample(rows: DataFrame, columns: list[str], key: str, most: int = 20_000) -> pd.DataFrame:
    """The first rows in the order of a hash of the key, at most so many, on the driver: what heads are fitted to."""
    return rows.where(F.col(columns[0]).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).select(key, *columns).toPandas()


#: Percentiles that are reported.
PERCENTILES = (1, 20, 50, 99.5, 99.9)


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys.., p1, p20, ..) of the values, exact, by linear interpolation; nulls do not count."""
    named = [F.round(F.percentile(value, p / 100), 9).alias(f"p{p:g}".replace(".", "_")) for p in PERCENTILES]
    return rows.groupBy(*keys).agg(*named)


def folds(movies: DataFrame, k: int = 5) -> DataFrame:
    """(dataset, embryo, fold): movies of an embryo dealt to k folds in the order of a hash of their names."""
    rows = movies.select("dataset").distinct().withColumn("embryo", F.split("dataset", "_")[0])
    return rows.withColumn("fold", ((F.row_number().over(W.partitionBy("embryo").orderBy(F.md5("dataset"), "dataset")) - 1) % k).cast("int"))


def training_events(links: DataFrame, det: DataFrame, most: int = 30) -> DataFrame:
    """(dataset, t, node_id, label): around divisions (the parent, the node before and the daughters) 1; single steps away from them 0.

    Of the latter, the first so many of each dataset in the order of a hash: this is a sampling operator.
    """
    out = links.groupBy("dataset", "source_id").agg(F.count("*").alias("n"))
    divides = out.where("n = 2").select(F.col("source_id").alias("node_id"))
    before = links.join(divides.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("node_id"))
    after = links.join(divides.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("node_id"))
    positive = divides.union(before).union(after).distinct()
    single = out.where("n = 1").select(F.col("source_id").alias("node_id")).join(links.select(F.col("target_id").alias("node_id")), "node_id", "left_semi").join(positive, "node_id", "left_anti")
    place = det.select("dataset", "t", "node_id")
    negative = place.join(single, "node_id", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.col("node_id").cast("string")), "node_id"))).where(F.col("k") <= most)
    return place.join(positive, "node_id", "left_semi").select("dataset", "t", "node_id", F.lit(1).alias("label")).unionByName(negative.select("dataset", "t", "node_id", F.lit(0).alias("label")))


def bounded_offset(rows: DataFrame, features: str, hidden: np.ndarray, out: np.ndarray, most: float = 2.0) -> DataFrame:
    """With dz, dy, dx: a two-layer head on a feature vector, its output squashed below a length.

    hidden: (features + 1, units), out: (units + 1, 3), the last row of each being the bias. Null features give nulls.
    """

    @F.pandas_udf("dz double, dy double, dx double")
    def predict(v: pd.Series) -> pd.DataFrame:
        known = v.notna().to_numpy()
        d = np.full((len(v), 3), np.nan)
        if known.any():
            x = np.stack(v[known].to_numpy()).astype(np.float64)
            d[known] = head_output(x, hidden, out, most)[0]
        return pd.DataFrame(d, columns=["dz", "dy", "dx"])

    return rows.withColumn("_d", predict(features)).select("*", "_d.*").drop("_d")
