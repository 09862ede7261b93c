"""Model jobs on Spark ML: base models, day folds, stacking, per-feature models, networks, sweeps."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from threading import Lock

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import cleaning as B
from dayglass.operators import encoders as D
from dayglass.operators import metrics as I
from dayglass.operators import scaling as S
from dayglass.operators import scoring as H
from dayglass.operators import task_trees
from dayglass.operators import trees as T
from dayglass.operators.encoders import to_long
from dayglass.operators.sketches import quantile_borders
from dayglass.operators.splits import exclude_days
from dayglass.roles import WEAK_COLUMNS, Roles
from dayglass.session import cut_lineage, shared_folder


@dataclass(frozen=True)
class TreeSettings:
    rounds: int
    depth: int
    rate: float
    bins: int
    min_leaf: int = 1
    #: Trees with so many leaves, grown best first; None for trees that are grown level by level.
    leaves: int | None = None
    l2: float = 1.0


# Rounds, depths (63: none stated), learning rates, bins, leaf sizes and leaves of the three base models.
BASE_MODELS = {
    "cat": TreeSettings(999, 7, 0.09976360026551613, 89),
    "light": TreeSettings(473, 63, 0.025199403190325702, 255, 20, leaves=300),
    "hist": TreeSettings(261, 12, 0.10659053116784906, 229, 184, leaves=130),
}
EXCLUDED_DAYS = (48, 50, 52)
#: Fits that a job with one model per day keeps under way at the same time.
AT_ONCE = 4
#: Rows in a part of a table that trees are fitted on.
PART_ROWS = 1 << 17
#: Parts that one task may fit all rounds on.
TASK_PARTS = 16


@dataclass(frozen=True)
class Preparation:
    """What a base table gets before the models: a recoded weekday category, products of columns, columns left out by model."""

    weekday: str | None = None
    factors: dict[str, str] = field(default_factory=dict)
    weak: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def features(self, features: list[str], model: str) -> list[str]:
        return [c for c in features if c not in self.weak.get(model, ())]


# The weekday category and the factors of the six products of the raw log.
RAW_PREPARATION = Preparation(
    "f_9",
    {"43": "f_43", "51": "f_51", "66": "f_66", "70": "f_70"},
    {"cat": WEAK_COLUMNS["cat"], "light": WEAK_COLUMNS["light"], "hist": WEAK_COLUMNS["light"]},
)


def smaller(settings: dict[str, TreeSettings], rounds: int, depth: int | None = None, leaves: int | None = None) -> dict[str, TreeSettings]:
    """The same models with fewer trees, and with fewer levels or leaves where these are given."""

    def least(a: int | None, b: int | None) -> int | None:
        return a if b is None else b if a is None else min(a, b)

    return {
        name: replace(s, rounds=min(rounds, s.rounds), depth=least(s.depth, depth), leaves=None if s.leaves is None else least(s.leaves, leaves))
        for name, s in settings.items()
    }


def model_table(
    df: DataFrame, roles: Roles, label: str = "is_installed", preparation: Preparation = Preparation()
) -> tuple[DataFrame, list[str]]:
    """(row id, day, label, features): categories as statistics of earlier days, NULL numerics as the mean."""
    if preparation.weekday:
        code = scalar.weekday_code(F.col(roles.day), F.col(preparation.weekday), scalar.WEEKDAY_CODES_RAW)
        df = df.withColumn(preparation.weekday, code)
    made = scalar.products(preparation.factors)
    df = df.select("*", *made)
    nums = [*roles.counter, *roles.numeric, *df.columns[len(df.columns) - len(made) :]]
    # Written, since the columns may be costly to work out and are read four times.
    base = cut_lineage(
        df.select(roles.row_id, roles.day, F.col(label).cast("int").alias(label), *roles.categorical, *roles.binary, *nums)
    )
    known = base.where(F.col(label).isNotNull())
    filled = B.fill(base, B.column_means(known, nums)) if nums else base
    filled = B.bools_to_int(filled, list(roles.binary))
    encoded = D.earlier_day_stats(filled, list(roles.categorical), label, roles.day, roles.row_id)
    return cut_lineage(encoded, by=roles.day), [*roles.categorical, *roles.binary, *nums]


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def fit_trees(
    train: DataFrame, features: list[str], label: str, settings: TreeSettings, weight: str | None = None, validation: str | None = None
) -> Model | task_trees.LevelTrees:
    """Boosted trees; rows with ``validation`` are not learned from, and rounds end when their loss no longer falls.

    Plain rounds over a table that fits a task run there; all others are Spark ML's, which grow the same trees in a job per level.
    """
    if weight is None and validation is None and _fits_a_task(train, features, label, settings):
        return task_trees.fit_levels(train, features, label, settings.rounds, settings.depth, settings.rate, max(2, settings.bins), settings.min_leaf)
    context = train.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(train.sparkSession))
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.rate,
        maxBins=max(2, settings.bins),
        minInstancesPerNode=settings.min_leaf,
        maxMemoryInMB=512,
        seed=7,
        **({"weightCol": weight} if weight else {}),
        **({"validationIndicatorCol": validation} if validation else {}),
    )
    return trees.fit(in_small_parts(_vectors(train, features).select("features", label, *[c for c in (weight, validation) if c])))


def _fits_a_task(train: DataFrame, features: list[str], label: str, settings: TreeSettings) -> bool:
    """Whether all values are there, with two labels, and no more of them than a task may hold."""
    values = [F.col(c).cast("double") for c in features]
    bad = reduce(or_, [v.isNull() | F.isnan(v) for v in values], F.col(label).isNull())
    y = F.col(label).cast("double")
    seen = train.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(y).alias("low"), F.max(y).alias("high")).first()
    few = 0 < seen["n"] <= TASK_PARTS * PART_ROWS and seen["n"] * len(features) <= task_trees.TASK_BINS
    return bool(few and features and not seen["bad"] and {seen["low"], seen["high"]} <= {0.0, 1.0} and settings.depth <= task_trees.MOST_LEVELS)


def in_small_parts(rows: DataFrame) -> DataFrame:
    """``rows`` in so many parts that each has about PART_ROWS. Spark's trees keep a part as objects in memory and read it as a whole in every pass."""
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def grow_leafwise(
    df: DataFrame,
    features: list[str],
    row_id: str,
    day: str,
    label: str,
    models: list[T.Model],
    settings: TreeSettings,
    borders: dict[str, list[float]] | None = None,
) -> T.Grown:
    """Best-first trees for several sets of days at once, on quantile bins of all rows unless ``borders`` are given."""
    if borders is None:
        borders = quantile_borders(df, features, settings.bins)
    leafwise = T.LeafwiseSettings(settings.rounds, settings.leaves, settings.rate, settings.min_leaf, settings.l2, settings.depth)
    grow = task_trees.grow_in_tasks if task_trees.fits_a_task(df, features) else T.grow
    return grow(df, row_id, day, label, features, borders, models, leafwise)


def own_model_scores(grown: T.Grown, row_id: str, day: str, of_day: dict[int, int]) -> DataFrame:
    """(row id, day, score): the probability of each row of the days in ``of_day`` by the model numbered there."""
    number = F.create_map(*[F.lit(x) for pair in of_day.items() for x in pair])[F.col(day)]
    rows = grown.scores.where(F.col(day).isin(list(of_day)))
    return cut_lineage(rows.select(row_id, day, scalar.sigmoid(F.get("raw", number)).alias("score")))


def score(model: Model | task_trees.LevelTrees, df: DataFrame, features: list[str], keep: list[str], out: str = "p") -> DataFrame:
    scored = model.transform(_vectors(df, features))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def side_by_side(job: Callable, over: Iterable) -> list:
    """``job`` of each, AT_ONCE of them sharing the cluster."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(job, over))


def base_model_scores(
    table: DataFrame,
    features: list[str],
    row_id: str,
    day: str,
    test_day: int,
    label: str = "is_installed",
    settings: dict[str, TreeSettings] = BASE_MODELS,
    preparation: Preparation = Preparation(),
) -> dict[str, DataFrame]:
    """Scores of the test day per base model, which learn side by side. The second and third model leave out three odd days."""
    train, test = table.where(F.col(day) < test_day), table.where(F.col(day) == test_day)
    days = days_before(table, day, test_day)

    def scored(name: str) -> DataFrame:
        s, used = settings[name], preparation.features(features, name)
        if s.leaves is None:
            rows = train if name == "cat" else exclude_days(train, day, EXCLUDED_DAYS)
            return score(fit_trees(rows, used, label, s), test, used, [row_id], "score")
        learned = tuple(d for d in days if name == "cat" or d not in EXCLUDED_DAYS)
        grown = grow_leafwise(table, used, row_id, day, label, [T.Model(learned)], s)
        return own_model_scores(grown, row_id, day, {test_day: 0}).drop(day)

    return dict(zip(settings, side_by_side(scored, settings)))


def days_before(table: DataFrame, day: str, test_day: int) -> list[int]:
    return sorted(r[0] for r in table.where(F.col(day) < test_day).select(F.col(day).cast("int")).distinct().collect())


def day_out_model_scores(
    table: DataFrame,
    features: list[str],
    row_id: str,
    day: str,
    days: list[int],
    settings: TreeSettings,
    label: str = "is_installed",
    test_day: int | None = None,
    borders: dict[str, list[float]] | None = None,
) -> DataFrame:
    """(row id, day, score): each row of ``days`` by a model that learned from the other ones of these days.

    With ``test_day`` its rows are scored too, by a model of all of ``days``. Leaf-wise models of all folds grow side by
    side from shared histograms; the others are fitted one per day, AT_ONCE of them sharing the cluster.
    """
    if settings.leaves is not None:
        models = [T.Model(tuple(d for d in days if d != fold)) for fold in days]
        of_day = {d: i for i, d in enumerate(days)}
        if test_day is not None:
            of_day[test_day] = len(models)
            models.append(T.Model(tuple(days)))
        rows = table.where(F.col(day).isin(list(of_day)))
        return own_model_scores(grow_leafwise(rows, features, row_id, day, label, models, settings, borders), row_id, day, of_day)
    known = table.where(F.col(day).isin(days))

    def fold(d: int) -> DataFrame:
        model = fit_trees(known.where(F.col(day) != d), features, label, settings)
        return score(model, table.where(F.col(day) == d), features, [row_id, day], "score")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(fold, [*days, *([] if test_day is None else [test_day])]))


def stacked_scores(
    table: DataFrame,
    features: list[str],
    row_id: str,
    day: str,
    test_day: int,
    fold_scores: DataFrame,
    models: list[str],
    settings: TreeSettings,
    label: str = "is_installed",
    borders: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Second-level model: the features plus first-level scores, which no row got from its own day."""
    joined = cut_lineage(table.join(fold_scores.select(row_id, *models), row_id), by=day)
    if settings.leaves is not None:
        learned = tuple(d for d in days_before(joined, day, test_day) if d not in EXCLUDED_DAYS)
        grown = grow_leafwise(joined, [*features, *models], row_id, day, label, [T.Model(learned)], settings, borders)
        return own_model_scores(grown, row_id, day, {test_day: 0}).drop(day)
    train, test = joined.where(F.col(day) < test_day), joined.where(F.col(day) == test_day)
    model = fit_trees(exclude_days(train, day, EXCLUDED_DAYS), [*features, *models], label, settings)
    return score(model, test, [*features, *models], [row_id], "score")


def walk_forward_scores(
    table: DataFrame,
    features: list[str],
    row_id: str,
    day: str,
    settings: TreeSettings,
    first_fold: int = 52,
    last_fold: int = 66,
    start: int = 0,
    label: str = "is_installed",
    weighted: bool = False,
    test_day: int | None = None,
) -> DataFrame:
    """(row id, fold, label, p): each fold day is scored by a model of the days before it.

    The fold day also tells the model when to stop adding rounds. With ``test_day`` a last model learns from all days
    before it, in all rounds, and scores it. ``weighted`` gives positives the ratio of negatives to positives as weight.
    The labels of all folds are counted in one pass, and AT_ONCE fits share the cluster.
    """
    counts: dict[int, tuple[int, int]] = {}
    if weighted:
        y = F.col(label).cast("int")
        by_day = table.groupBy(F.col(day).cast("int").alias(day)).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
        counts = {r[day]: (r["n0"], r["n1"]) for r in by_day.where(F.col(day).isNotNull()).collect()}

    def scored(fold: int) -> DataFrame:
        train = table.where((F.col(day) >= start) & (F.col(day) < fold))
        weight = None
        if weighted:
            negatives, positives = (sum(n[i] for d, n in counts.items() if start <= d < fold) for i in (0, 1))
            weight = "__weight"
            train = train.withColumn(weight, F.when(F.col(label) == 1, F.lit(negatives / positives if positives else 1.0)).otherwise(1.0))
        val = table.where(F.col(day) == fold).withColumn("fold", F.lit(fold))
        if fold == test_day:
            model = fit_trees(train, features, label, settings, weight)
        else:
            stop = val.drop("fold").withColumn("__stop", F.lit(True))
            if weight:
                stop = stop.withColumn(weight, F.lit(1.0))
            both = train.withColumn("__stop", F.lit(False)).unionByName(stop)
            model = fit_trees(both, features, label, settings, weight, "__stop")
        return score(model, val, features, [row_id, "fold", label])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(scored, [*range(first_fold, last_fold + 1), *([] if test_day is None else [test_day])]))


def cat_then_num_scores(
    table: DataFrame, cats: list[str], others: list[str], row_id: str, day: str, split_day: int, settings: TreeSettings, label: str = "is_installed"
) -> DataFrame:
    """A model on the categories gives one feature of a second model on the remaining columns."""
    first = fit_trees(table.where(F.col(day) < split_day), cats, label, settings)
    widened = cut_lineage(score(first, table, cats, [row_id, day, label, *others], "cat_score"), by=day)
    second = fit_trees(widened.where(F.col(day) < split_day), [*others, "cat_score"], label, settings)
    return score(second, widened.where(F.col(day) >= split_day), [*others, "cat_score"], [row_id, label])


def per_feature_rates(train: DataFrame, val: DataFrame, columns: list[str], label: str = "is_installed") -> DataFrame:
    """One weighted-rate classifier per category column, in closed form, with its confusion cells on ``val``.

    The balanced class weights make the rate of a value w1 n1 / (w1 n1 + w0 n0); unseen values are class 0. All
    columns go through one aggregation per table; only (column, value) totals are joined.
    """
    y = F.col(label).cast("int")
    w = {r[label]: r["weight"] for r in I.class_weights(train.select(y.alias(label)), label).collect()}

    def totals(df: DataFrame) -> DataFrame:
        long = to_long(df.select(*columns, y.alias("__y")), columns, ["__y"])
        return long.groupBy("column", "value").agg(F.count_if(F.col("__y") == 1).alias("n1"), F.count_if(F.col("__y") == 0).alias("n0"))

    positive = F.col("n1") * w.get(1, 0.0)
    classes = totals(train).select(
        "column", F.coalesce("value", F.lit("\u0000")).alias("value"), (positive / (positive + F.col("n0") * w.get(0, 0.0)) > 0.5).alias("yes")
    )
    seen = totals(val).withColumn("value", F.coalesce("value", F.lit("\u0000"))).join(classes, ["column", "value"], "left")
    yes = F.coalesce("yes", F.lit(False))
    cells = seen.groupBy(F.col("column").alias("feature")).agg(
        *[
            F.sum(F.when(side, F.col(n)).otherwise(0)).alias(name)
            for name, side, n in (("tn", ~yes, "n0"), ("fp", yes, "n0"), ("fn", ~yes, "n1"), ("tp", yes, "n1"))
        ]
    )
    return I.accuracy_f1(cells)


def per_feature_logistic(train: DataFrame, val: DataFrame, columns: list[str], label: str = "is_installed", rounds: int = 20) -> DataFrame:
    """One weighted logistic regression per numeric column, with its confusion cells on ``val``."""
    weights = {r[label]: r["weight"] for r in I.class_weights(train.select(F.col(label).cast("int").alias(label)), label).collect()}
    y = F.col(label).cast("int").alias(label)
    weight = F.when(F.col(label).cast("int") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)).alias("__weight")
    results = []
    for c in columns:
        spread = S.fit_zscore(train, [c])
        x = F.coalesce(S.scaled(c, spread), F.lit(0.0)).alias(c)
        model = LogisticRegression(labelCol=label, weightCol="__weight", maxIter=rounds).fit(_vectors(train.select(x, y, weight), [c]))
        predicted = model.transform(_vectors(val.select(x, y), [c])).withColumn("predicted", F.col("prediction").cast("int"))
        results.append(I.confusion_matrix(predicted, label, "predicted").withColumn("feature", F.lit(c)))
    return I.accuracy_f1(reduce(DataFrame.unionByName, results))


def network_scores(
    train: DataFrame, val: DataFrame, features: list[str], row_id: str, hidden: list[int], label: str = "is_installed", rounds: int = 100
) -> DataFrame:
    """Feed-forward network with the given hidden layers."""
    network = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *hidden, 2], maxIter=rounds, seed=7)
    return score(network.fit(_vectors(train, features)), val, features, [row_id, label])


@dataclass(frozen=True)
class Components:
    means: list[float]
    vectors: np.ndarray  # one column per kept component
    shares: list[float]


def fit_components(df: DataFrame, features: str, share: float = 0.95) -> Components:
    """The fewest components that explain ``share`` of the variance of an array column."""
    rows = df.select(array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("raw"))
    centring = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows)
    width = len(centring.mean)
    fitted = PCA(k=width, inputCol="centred", outputCol="scores").fit(centring.transform(rows))
    shares = fitted.explainedVariance.toArray()
    kept = min(width, int(np.searchsorted(np.cumsum(shares), share - 1e-12) + 1))
    return Components(list(centring.mean.toArray()), fitted.pc.toArray()[:, :kept], [float(v) for v in shares])


def project(df: DataFrame, features: str, components: Components) -> DataFrame:
    """Adds ``scores`` (kept components) and ``rebuilt`` (back in the original axes)."""
    means, vectors = np.array(components.means), components.vectors

    @F.pandas_udf("scores array<double>, rebuilt array<double>")
    def both(values: pd.Series) -> pd.DataFrame:
        scores = (np.array(values.tolist(), dtype=float) - means) @ vectors
        return pd.DataFrame({"scores": list(scores), "rebuilt": list(scores @ vectors.T + means)})

    done = df.withColumn("__both", both(F.transform(features, lambda v: v.cast("double"))))
    return done.select(*df.columns, "__both.scores", "__both.rebuilt")


def reconstruction_similarity(df: DataFrame, features: str, label: str, share: float = 0.95) -> DataFrame:
    """Cosine of each row with its reconstruction, mean and deviation per label."""
    return I.cosine_by_label(project(df, features, fit_components(df, features, share)), features, "rebuilt", label)


def sweep(trial: Callable[[dict], dict[str, float]], settings: dict[str, list], trials: int | None = None, seed: int = 42) -> list[dict]:
    """Run a grid of settings, or ``trials`` of them drawn with a seed; one record per trial. AT_ONCE trials share the cluster."""
    grid = [{}]
    for name, values in settings.items():
        grid = [{**g, name: v} for g in grid for v in values]
    if trials is not None and trials < len(grid):
        grid = random.Random(seed).sample(grid, trials)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [{"trial": i, **g, **found} for i, (g, found) in enumerate(zip(grid, pool.map(trial, grid)))]


def cluster_rate_trial(
    train: DataFrame, val: DataFrame, features: list[str], row_id: str, label: str = "is_installed"
) -> Callable[[dict], dict[str, float]]:
    """A trial: weighted k-means on train, rates per cluster, log loss of the pulled rates on val.

    Trials that differ in their pull alone share one fit, one scan of train for the rates and one of val.
    """
    rows = {name: cut_lineage(_vectors(df, features).select(row_id, label, "features")) for name, df in (("train", train), ("val", val))}
    fits: dict[tuple, Future] = {}
    claim = Lock()

    def clusters(k: int, positive_weight: float, rounds: int, init: str) -> tuple[DataFrame, DataFrame]:
        weight = F.when(F.col(label) == 1, positive_weight).otherwise(1.0)
        model = KMeans(
            k=k, maxIter=rounds, initMode=init, seed=42, predictionCol="cluster", weightCol="weight",
        ).fit(rows["train"].withColumn("weight", weight))
        rates = cut_lineage(H.cluster_rates(model.transform(rows["train"]), "cluster", label))
        return rates, cut_lineage(model.transform(rows["val"]).select(row_id, label, "cluster"))

    def trial(setting: dict) -> dict[str, float]:
        key = (setting["k"], float(setting.get("positive_weight", 1.0)), setting.get("rounds", 5), setting.get("init", "k-means||"))
        with claim:
            own = key not in fits
            fit = fits.setdefault(key, Future())
        if own:
            try:
                fit.set_result(clusters(*key))
            except BaseException as error:
                fit.set_exception(error)
        rates, clustered = fit.result()
        predicted = H.cluster_rate_predict(clustered, rates, "cluster", setting.get("pull", 1.0))
        return {"log_loss": I.log_loss(predicted, label, "prediction").first()["log_loss"]}

    return trial
