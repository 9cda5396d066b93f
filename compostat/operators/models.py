"""Scores of classifiers as aggregates, and cross-validated models on MLlib."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import cut
from .diversity import average_rank


def roc_auc(scores: DataFrame, by: Sequence[str] = ("fold",), y: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only."""
    ranked = scores.withColumn("__r", average_rank(score, by))
    n1, n0 = F.sum(F.col(y).cast("double")), F.sum(1.0 - F.col(y))
    return ranked.groupBy(*by).agg(((F.sum(F.when(F.col(y) == 1, F.col("__r"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"), F.count(F.lit(1)).alias("n_test"), n1.cast("bigint").alias("n_test_pos"))


def recalls(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "prediction") -> DataFrame:
    return predictions.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("recall"))


def accuracy(predictions: DataFrame, by: Sequence[str] = ("fold",), label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, balanced accuracy (mean recall of classes) and the majority baseline."""
    per = recalls(predictions, by, label, predicted)
    return per.groupBy(*by).agg((F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), (F.max("n") / F.sum("n")).alias("majority_baseline"), F.sum("n").alias("n_test"))


def top_k(scores: DataFrame, key: str, k: int = 5, label: str = "label", cls: str = "cls", score: str = "score") -> DataFrame:
    """Per row the best class and whether the label is among the ``k`` best; ties by class."""
    w = Window.partitionBy(key).orderBy(F.desc(score), cls)
    best = scores.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k)
    return best.groupBy(key, label).agg(F.min_by(cls, "__k").alias("predicted"), F.bool_or(F.col(cls) == F.col(label)).alias("in_top_k"))


def summary(scores: DataFrame, by: Sequence[str], metric: str = "auc") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(metric).alias("mean_score"), F.stddev_samp(metric).alias("sd_score"), F.count(metric).alias("n_folds"))


def leakage_gap(scores: DataFrame, by: Sequence[str], scheme: str = "cv_scheme", metric: str = "auc", honest: str = "lopo", leaky: str = "random") -> DataFrame:
    """Mean score per scheme side by side, and how much the leaky one gains."""
    wide = scores.groupBy(*by).pivot(scheme, [honest, leaky]).agg(F.avg(metric))
    return wide.withColumn("gap", F.col(leaky) - F.col(honest))


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Codes from 0 by sorted label."""
    codes = df.select(label).distinct().withColumn(out, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(codes, label)


def _scaled(train: DataFrame, test: DataFrame, features: str):
    from pyspark.ml.feature import StandardScaler

    model = StandardScaler(inputCol=features, outputCol="__x", withMean=True, withStd=True).fit(train)
    return model.transform(train), model.transform(test)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = df.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(label).alias("__k"))
    return df.join(counts, label).join(F.broadcast(total)).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def make_model(kind: str, features: str, label: str, **kw):
    from pyspark.ml import classification as C

    if kind == "logreg":
        return C.LogisticRegression(featuresCol=features, labelCol=label, regParam=kw.get("reg", 0.01), maxIter=kw.get("max_iter", 50), weightCol="weight", standardization=False)
    if kind == "gboost":
        return C.GBTClassifier(featuresCol=features, labelCol=label, maxIter=kw.get("max_iter", 30), stepSize=kw.get("step", 0.05), maxDepth=kw.get("depth", 3), seed=kw.get("seed", 42), weightCol="weight")
    if kind == "linear":
        return C.LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=kw.get("reg", 1e-3), maxIter=kw.get("max_iter", 50))
    if kind == "mlp":
        return C.MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=kw["layers"], maxIter=kw.get("max_iter", 60), seed=kw.get("seed", 42))
    raise ValueError(f"no model {kind!r}")


def cross_validated(df: DataFrame, kinds: Sequence[str], fold: str = "fold", label: str = "y", features: str = "features", key: str = "sample", **kw) -> DataFrame:
    """Out-of-fold scores ``(model, fold, key, label, score, prediction)``.  Each fold fits a
    scaler and the models on the rest; fits are distributed jobs.  Folds whose rest has one
    label only are skipped; if all are, there is no row."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        if train.select(label).distinct().limit(2).count() < 2:
            continue
        train, test = _scaled(balanced_weights(train, label), test, features)
        for kind in kinds:
            model = make_model(kind, "__x", label, **kw).fit(train)
            got = model.transform(test).select(F.lit(kind).alias("model"), F.lit(f).cast("int").alias(fold), key, F.col(label).cast("double").alias(label), vector_to_array("probability")[1].alias("score"), "prediction")
            out = got if out is None else out.unionByName(got)
    if out is None:
        kept = df.select(key).schema[0].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"model string, `{fold}` int, `{key}` {kept}, `{label}` double, score double, prediction double")
    return out


def folds_of(df: DataFrame, schemes: Sequence[tuple[str, DataFrame]]) -> Iterator[tuple[str, DataFrame]]:
    """(scheme, table with folds) pairs, for comparing schemes on one table."""
    for name, folds in schemes:
        yield name, df.join(folds, "sample")


def simplified_graph_features(edges: DataFrame, vertices: DataFrame, hops: int = 2) -> DataFrame:
    """Features after ``hops`` rounds of message passing without parameters, for a flat
    classifier (simplified graph convolution)."""
    from .graphs import combine, propagate

    out = vertices
    for _ in range(hops):
        out = combine(out, propagate(edges, out), 0.5, 0.5)
    return out


def paired_gaps(scores: DataFrame, by: Sequence[str], arm: str, base: str, other: str, metric: str = "auc", seed: str = "seed") -> DataFrame:
    """Per group the mean and deviation over seeds of ``other`` less ``base``, paired by
    seed after averaging folds."""
    per = scores.groupBy(*by, seed).pivot(arm, [base, other]).agg(F.avg(metric)).withColumn("gap", F.col(other) - F.col(base))
    return per.groupBy(*by).agg(F.avg("gap").alias("gap_mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("gap_sd"), F.count("gap").alias("n_seeds"))


def drop_small_classes(df: DataFrame, label: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of classes with at least ``least`` rows, and what was dropped: classes, rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    kept = df.join(sizes.filter(F.col("n") >= least).select(label), label, "left_semi")
    return kept, sizes.agg(F.count(F.lit(1)).alias("n_classes"), F.count_if(F.col("n") < least).alias("n_classes_dropped"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)).alias("n_rows_dropped"))


def class_scores(df: DataFrame, kinds: Sequence[str], label: str = "project", features: str = "features", key: str = "sample", folds: int = 5, least: int = 25, seed: int = 42, **kw) -> DataFrame:
    """Out-of-fold scores ``(model, fold, key, label, cls, score)`` of every class, classes
    as codes in label order; small classes are dropped first."""
    from pyspark.ml.functions import vector_to_array

    from .sampling import stratified_folds

    kept = encode_labels(drop_small_classes(df, label, least)[0], label).withColumn("code", F.col("code").cast("double"))
    dealt = stratified_folds(kept, "code", key, folds, seed)
    n_classes = dealt.select("code").distinct().count()
    width = len(dealt.select(vector_to_array(features)).first()[0])
    out = None
    for f in range(folds):
        train, test = _scaled(dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f), features)
        for kind in kinds:
            args = {"layers": [width, *kw.get("hidden", (64,)), n_classes], **kw} if kind == "mlp" else kw
            got = make_model(kind, "__x", "code", **args).fit(train).transform(test)
            one = got.select(F.lit(kind).alias("model"), "fold", key, F.col("code").cast("int").alias("label"), F.posexplode(vector_to_array("probability")).alias("cls", "score"))
            out = one if out is None else out.unionByName(one)
    return out


def class_summary(scores: DataFrame, key: str = "sample", k: int = 5) -> DataFrame:
    """Accuracy, balanced accuracy, top-k accuracy and baseline per model and fold."""
    w = Window.partitionBy("model", "fold", key).orderBy(F.desc("score"), "cls")
    best = scores.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k)
    per = best.groupBy("model", "fold", key, "label").agg(F.min_by("cls", "__k").alias("prediction"), F.bool_or(F.col("cls") == F.col("label")).alias("hit"))
    top = per.groupBy("model", "fold").agg(F.avg(F.col("hit").cast("double")).alias("topk_accuracy"))
    return accuracy(per, ["model", "fold"]).join(top, ["model", "fold"])


def graph_cross_validated(edges: DataFrame, vertices: DataFrame, labels: DataFrame, protocols: Sequence[str] = ("transductive", "inductive", "receivers"), hops: int = 2) -> DataFrame:
    """Out-of-fold scores of a flat classifier on propagated features, for ``labels (sample, y,
    fold)``.  transductive: all edges; inductive: training sees only edges among training
    samples; receivers: held-out samples take messages but send none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .graphs import induced, receivers_only

    def features(e: DataFrame) -> DataFrame:
        got = simplified_graph_features(e, vertices, hops).filter("type = 'sample'")
        return got.groupBy(F.col("id").alias("sample")).agg(array_to_vector(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"])).alias("features"))

    # Features are written, a row a sample, so that no fold keeps the shuffles of its propagation.
    flat = lambda e: cut(features(e), "graph-features")
    out = None
    whole = flat(edges) if {"transductive", "inductive"} & set(protocols) else None
    for f in sorted(r[0] for r in labels.select("fold").distinct().collect()):
        train, test = labels.filter(F.col("fold") != f), labels.filter(F.col("fold") == f)
        for protocol in protocols:
            if protocol == "transductive":
                seen = tested = whole
            elif protocol == "inductive":
                seen, tested = flat(induced(edges, train)), whole
            elif protocol == "receivers":
                seen = tested = flat(receivers_only(edges, train))
            else:
                raise ValueError(f"no protocol {protocol!r}")
            fit_on = balanced_weights(train.join(seen, "sample"), "y").persist()  # read by the scaler and by every step of the fit
            a, b = _scaled(fit_on, test.join(tested, "sample"), "features")
            got = make_model("logreg", "__x", "y").fit(a).transform(b)
            one = got.select(F.lit(protocol).alias("protocol"), F.lit(f).cast("int").alias("fold"), "sample", "y", vector_to_array("probability")[1].alias("score"))
            out = one if out is None else out.unionByName(one)
    return out
