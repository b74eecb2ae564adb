"""Models on window feature tables, with Spark ML."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentrylake.functions import fixed_values as V
from sentrylake.functions.scale import top_k_per_group


def class_weights(rows: DataFrame, label="label", fixed=None) -> DataFrame:
    """Adds `weight`: balanced n/(k*n_c), or the given weight per class."""
    if fixed is not None:
        value = F.coalesce(*[F.when(F.col(label) == k, float(v)) for k, v in fixed.items()], F.lit(1.0))
        return rows.withColumn("weight", value)
    per = rows.groupBy(label).agg(F.count("*").alias("_nc"))
    total = per.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    weights = per.crossJoin(F.broadcast(total)).select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight")
    )
    # one row per class
    return rows.join(F.broadcast(weights), label)


def feature_pipeline(features=V.WINDOW_FEATURES, scale=True):
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return stages


def scale_features(train: DataFrame, rows: DataFrame, features=V.WINDOW_FEATURES) -> DataFrame:
    """z-scores by the training mean and population std; constant features become 0."""
    stats = train.agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    z = lambda f: F.coalesce(
        F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}"))),
        F.lit(0.0),
    )
    return rows.crossJoin(F.broadcast(stats)).select(
        *[c for c in rows.columns if c not in features], *[z(f).alias(f) for f in features]
    )


COMMON = dict(featuresCol="features", labelCol="label", weightCol="weight")


def logistic_regression(l1=0.0):
    return LogisticRegression(regParam=l1, elasticNetParam=1.0 if l1 else 0.0, maxIter=200, **COMMON)


def random_forest(trees=100, depth=8, seed=42, min_leaf=1):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=min_leaf, **COMMON)


def gradient_boosting(rounds=30, depth=5, step=0.1, seed=42):
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **COMMON)


def decision_tree(depth=2, seed=42):
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, **COMMON)


def fit(train: DataFrame, estimator, features=V.WINDOW_FEATURES, fixed_weights=None):
    """A fitted pipeline: assemble, scale on train, classify with class weights."""
    weighted = class_weights(train.withColumn("label", F.col("label").cast("double")), fixed=fixed_weights)
    return Pipeline(stages=[*feature_pipeline(features), estimator]).fit(weighted)


def _positive():
    """Probability of class 1; 0 when training saw one class only."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def score_new_table(model, rows: DataFrame, features=V.WINDOW_FEATURES, keep=("window_id",)) -> DataFrame:
    """Scores of an unseen table; absent feature columns are 0."""
    filled = rows.withColumns({f: F.lit(0.0) for f in features if f not in rows.columns})
    scored = model.transform(filled.withColumn("weight", F.lit(1.0)))
    return scored.select(*keep, _positive().alias("score"))


def feature_importance(model, features=V.WINDOW_FEATURES) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def majority_baseline(train: DataFrame, rows: DataFrame, label="label", keep=("window_id",)) -> DataFrame:
    share = train.agg(F.avg(label).alias("score"))
    return rows.select(*keep).crossJoin(F.broadcast(share))


def platt_calibration(train: DataFrame, rows: DataFrame, estimator, features=V.WINDOW_FEATURES, folds=3, seed=42):
    """Sigmoid-calibrated scores: out-of-fold scores of train fit a one-feature logistic."""
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), "window_id"), F.lit(folds)))
    held = None
    for k in range(folds):
        model = fit(folded.filter(F.col("_fold") != k), estimator, features)
        part = score_new_table(model, folded.filter(F.col("_fold") == k), features, keep=("label",))
        held = part if held is None else held.unionByName(part)
    sigmoid = Pipeline(
        stages=[VectorAssembler(inputCols=["score"], outputCol="features"),
                LogisticRegression(labelCol="label", maxIter=200)]
    ).fit(held.withColumn("label", F.col("label").cast("double")))
    base = score_new_table(fit(train, estimator, features), rows, features, keep=("window_id",))
    return sigmoid.transform(base).select(
        "window_id", F.col("score").alias("raw_score"), _positive().alias("score")
    )


META_FEATURES = ["base_prob", "temporal_smoothed", "auth_signal", "proc_signal", "corr_signal", "multi_source"]


def meta_features(windows: DataFrame, scored: DataFrame, split="split") -> DataFrame:
    """Stacking inputs: base score, its trailing mean of three, and four signals."""
    trailing = W.partitionBy(split).orderBy("window_id").rowsBetween(-2, 0)
    return windows.join(scored.select("window_id", F.col("score").alias("base_prob")), "window_id").select(
        "window_id", split, "label", "base_prob",
        F.avg("base_prob").over(trailing).alias("temporal_smoothed"),
        (F.col("auth_fail_rate") + F.col("auth_off_hours")).alias("auth_signal"),
        F.col("proc_rare").alias("proc_signal"),
        F.col("auth_proc_interaction").alias("corr_signal"),
        F.col("multi_source_flag").alias("multi_source"),
    )


def meta_classifier(windows: DataFrame, base_model, split="split", train="train") -> DataFrame:
    """Scores of a balanced logistic stack over the base model's scores."""
    inputs = meta_features(windows, score_new_table(base_model, windows))
    model = fit(inputs.filter(F.col(split) == train), logistic_regression(), META_FEATURES)
    return score_new_table(model, inputs, META_FEATURES, keep=("window_id", split, "label"))


def feature_ablation(windows: DataFrame, stages, estimator=None, train="train", test="test") -> DataFrame:
    """Scores of the test split per named column subset; evaluate them by stage."""
    out = None
    for name, columns in stages.items():
        model = fit(windows.filter(F.col("split") == train), estimator or random_forest(trees=50), columns)
        part = score_new_table(
            model, windows.filter(F.col("split") == test), columns, keep=("window_id", "label")
        ).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def drop_one(windows: DataFrame, features, estimator=None, train="train", test="test") -> DataFrame:
    """Test scores with all columns (stage `none`) and with each one left out (stage = its name)."""
    stages = {"none": list(features)} | {f: [g for g in features if g != f] for f in features}
    return feature_ablation(windows, stages, estimator, train, test)


# --- certificates: what must hold for a fit, whatever the implementation -----------

def _row(df, model, certificate, holds):
    return df.agg(holds.cast("int").alias("holds")).select(F.lit(model).alias("model"), F.lit(certificate).alias("certificate"), "holds")


def stationary(model, train: DataFrame, name, label="label", at_most=1e-4) -> DataFrame:
    """An unpenalised logistic fit: the weighted mean of (p - y) x is 0 in every scaled feature, and of p - y."""
    rows = model.transform(class_weights(train.withColumn(label, F.col(label).cast("double"))))
    error = F.col("weight") * (_positive() - F.col(label))
    each = rows.select(error.alias("e"), "weight", F.posexplode(F.concat(F.array(F.lit(1.0)), vector_to_array("features"))).alias("j", "x"))
    slopes = each.groupBy("j").agg((F.sum(F.col("e") * F.col("x")) / F.sum("weight")).alias("g"))
    return _row(slopes, name, "gradient_zero", F.max(F.abs("g")) <= at_most)


def calibrated_leaves(model, train: DataFrame, name, label="label") -> DataFrame:
    """A single tree: every score is the weighted share of positives among the training rows that get it."""
    rows = model.transform(class_weights(train.withColumn(label, F.col(label).cast("double"))))
    leaves = rows.select(_positive().alias("score"), label, "weight").groupBy("score").agg(
        (F.sum(F.col(label) * F.col("weight")) / F.sum("weight")).alias("share"))
    return _row(leaves, name, "leaf_shares", F.max(F.abs(F.col("score") - F.col("share"))) <= 1e-9)


def better_than_prevalence(model, train: DataFrame, name, label="label") -> DataFrame:
    """The weighted log loss on the training rows is below that of a constant score, which is log 2 under balanced weights."""
    rows = model.transform(class_weights(train.withColumn(label, F.col(label).cast("double"))))
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), _positive()))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)) * F.col("weight")
    return _row(rows.select(loss.alias("loss"), "weight"), name, "below_prevalence", F.sum("loss") / F.sum("weight") < float(np.log(2)))


def no_inversion(scores: DataFrame, raw, score, name) -> DataFrame:
    """A calibration keeps the order: among distinct raw scores, the calibrated one never falls."""
    spans = scores.groupBy(raw).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    earlier = W.orderBy(raw).rowsBetween(W.unboundedPreceding, -1)
    falls = spans.withColumn("_top", F.max("hi").over(earlier)).select((F.col("lo") < F.col("_top") - 1e-12).alias("falls"))
    return _row(falls, name, "no_inversion", F.count_if("falls") == 0)


def whole_shares(importance: DataFrame, name) -> DataFrame:
    return _row(importance, name, "sum_to_one", (F.abs(F.sum("importance") - 1) < 1e-9) & (F.min("importance") >= 0))


def sound_trees(forest: DataFrame, name) -> DataFrame:
    """Isolation trees: every inner node's rows are those of its two children."""
    inner = forest.filter("feature >= 0").select("tree", "node", "size")
    children = forest.select("tree", F.floor(F.col("node") / 2).alias("node"), F.col("size").alias("_part"))
    both = inner.join(children, ["tree", "node"]).groupBy("tree", "node", "size").agg(F.sum("_part").alias("_parts"), F.count("*").alias("_n"))
    return _row(both, name, "children_add_up", F.count_if((F.col("size") != F.col("_parts")) | (F.col("_n") != 2)) == 0)


# --- isolation forest (published algorithm: random splits, path length) ------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, size long"
HARMONIC = 0.5772156649


def _average_path(n):
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + HARMONIC) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(features, depth, seed):
    """Grow one tree on its subsample; nodes are numbered 1, 2i, 2i+1."""

    def build(key, pdf):
        tree = int(key[0])
        rng = np.random.default_rng(seed + tree)
        x = pdf[features].to_numpy(dtype=float)
        rows, todo = [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, idx, level = todo.pop()
            part = x[idx]
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(idx) > 1 else []
            if level >= depth or len(spread) == 0:
                rows.append((tree, node, -1, 0.0, len(idx)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] < cut
            rows.append((tree, node, f, cut, len(idx)))
            todo += [(2 * node, idx[left], level + 1), (2 * node + 1, idx[~left], level + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "size"])

    return build


def isolation_forest(train: DataFrame, features, trees=100, sample=256, seed=42, key="window_id"):
    """Trees as a table. Each tree takes the `sample` rows with the lowest per-tree hash.

    A row enters the lottery of those trees for which its hash is below a share
    that leaves about eight times the sample, so the rows sent on are bounded by
    trees * sample, not by the table.
    """
    total = train.count()
    bound = min(2**63 - 1, int((min(1.0, sample * 8.0 / max(1, total)) - 0.5) * 2**64))
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.lit(seed), t, F.col(key)) <= F.lit(bound)
    )
    lots = train.select(key, *features, F.explode(drawn).alias("tree")).withColumn(
        "_h", F.xxhash64(F.lit(seed), "tree", key))
    picked = top_k_per_group(lots, ["tree"], [F.col("_h"), F.col(key)], sample)
    depth = int(np.ceil(np.log2(max(2, min(sample, total)))))
    return picked.groupBy("tree").applyInPandas(_grow(list(features), depth, seed), TREE_SCHEMA)


def isolation_scores(forest: DataFrame, rows: DataFrame, features, key="window_id") -> DataFrame:
    """Anomaly score 2^(-mean path / c(sample)) per row.

    The trees are at most trees * 2 * sample nodes, a fixed size, and are sent
    to the tasks; rows stay distributed. Without trees, as after a training table
    without rows, the score is null.
    """
    nodes = forest.toPandas()
    if nodes.empty:
        return rows.select(key, F.lit(None).cast("double").alias("raw"))
    root_size = int(nodes.loc[nodes["node"] == 1, "size"].max())
    packed = [
        (dict(zip(t["node"], zip(t["feature"], t["cut"], t["size"]))))
        for _, t in nodes.groupby("tree")
    ]
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    names = list(features)

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for tree in shared.value:
                todo = [(1, np.arange(len(x)), 0)]
                while todo:
                    node, idx, level = todo.pop()
                    f, cut, size = tree[node]
                    if f < 0:
                        total[idx] += level + float(_average_path(size))
                        continue
                    left = x[idx, f] < cut
                    todo += [(2 * node, idx[left], level + 1), (2 * node + 1, idx[~left], level + 1)]
            mean = total / max(1, len(shared.value))
            yield pd.DataFrame({key: pdf[key], "raw": 2.0 ** (-mean / max(1e-9, float(_average_path(root_size))))})

    kind = dict(rows.dtypes)[key]
    raw = rows.select(key, *[F.col(f).cast("double").alias(f) for f in names]).mapInPandas(
        score, f"{key} {kind}, raw double"
    )
    return raw


def scaled_by(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Min-max scale `raw` by a reference table's range, clipped to 0..1; null without either."""
    span = reference.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    share = (F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    # greatest and least pass over nulls
    return scores.crossJoin(F.broadcast(span)).withColumn(
        "score", F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    ).drop("_lo", "_hi")
