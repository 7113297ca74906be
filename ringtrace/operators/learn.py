"""Detector protocols on MLlib: any estimator, grouped folds, blocks, scenarios and time."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fits, geometry as G, partition as P, reports as R
from ..sources.io import cut


def forest(trees: int = 20, depth: int = 6, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="idx", numTrees=trees, maxDepth=depth, seed=seed)


def fit(train: DataFrame, cols: list[str], label: str, model=None, scaled: bool = False):
    """A fitted pipeline: labels indexed, features assembled and, where the model wants it, scaled; for trees, in bins."""
    model = model or forest()
    index = StringIndexer(inputCol=label, outputCol="idx", handleInvalid="keep", stringOrderType="alphabetAsc")
    rows = P.matrix(train, cols)
    if not scaled and in_bins(model):
        return fit_bins(rows, cols, index, model)
    raw = "raw" if scaled else "features"
    stages = [index, VectorAssembler(inputCols=cols, outputCol=raw, handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, model]).fit(rows)


#: Ranks at which a feature's values are read to lay its bins.
PROBES = 1024
#: Instances a forest's draws are made of: up to so many rows each is drawn alone, of more equal rows are drawn in blocks.
DRAWN = 500_000


def in_bins(model) -> bool:
    """Whether the learner sees a feature's bin only, as Spark's trees do; a least number of rows a leaf counts rows, not weights."""
    tree = model.getClassifier() if isinstance(model, OneVsRest) else model
    return isinstance(tree, (RandomForestClassifier, GBTClassifier, DecisionTreeClassifier)) and tree.getMinInstancesPerNode() == 1


def bin_edges(rows: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Inner edges of at most ``bins`` bins of each feature, all its values where they are few, else about equal shares of the rows.

    The rule is that of Spark's trees, over quantiles of all rows in place of a sample.
    """
    shares = F.expr(f"array({', '.join(f'{k / PROBES!r}D' for k in range(PROBES + 1))})")  # one expression, not a call for each
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{k}") for k, c in enumerate(cols)]).first()  # ``PROBES`` numbers a feature
    return [_edges(q or [], bins) for q in found]


def _edges(probes: list[float], bins: int) -> list[float]:
    counts = Counter(probes)
    values = sorted(counts)
    between = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(values) <= bins:
        return between
    stride, seen, edges = len(probes) / bins, 0, []
    for v, edge in zip(values, between):
        seen += counts[v]
        target = stride * (len(edges) + 1)
        if len(edges) < bins - 1 and abs(seen - target) < abs(seen + counts[values[bisect_right(values, v)]] - target):
            edges.append(edge)
    return edges


def fit_bins(rows: DataFrame, cols: list[str], index: StringIndexer, model) -> PipelineModel:
    """Trees of the counts of equal rows: rows are equal to a tree if all bins and the label are.

    A count is an instance's weight.  A forest draws instances, so counts are dealt to as many equal blocks as make about ``DRAWN`` in all:
    a training set of no more rows goes in row by row.
    """
    spark = rows.sparkSession
    tree = model.getClassifier() if isinstance(model, OneVsRest) else model
    outs = [f"bin_{k}" for k in range(len(cols))]
    indexed = index.fit(rows)
    inner = bin_edges(rows, cols, tree.getMaxBins())
    bucket = Bucketizer(splitsArray=[[-float("inf"), *(e or [0.0]), float("inf")] for e in inner], inputCols=cols, outputCols=outs)
    cells = cut(bucket.transform(indexed.transform(rows)).groupBy("idx", *outs).agg(F.count("*").alias("n")), "cells")
    most = max(1.0, (cells.agg(F.sum("n")).first()[0] or 0) / DRAWN)
    blocks = F.ceil(F.col("n") / F.lit(most)).cast("int")
    drawn = cells.select("idx", *outs, (F.col("n") / blocks).alias("weight"), F.explode(F.sequence(F.lit(1), blocks)).alias("block")).drop("block")
    drawn = cut(drawn.repartition(spark.sparkContext.defaultParallelism), "drawn")  # a small file would be one task in every pass
    assemble = VectorAssembler(inputCols=outs, outputCol="features")
    return PipelineModel([indexed, bucket, assemble, model.copy({model.weightCol: "weight"}).fit(assemble.transform(drawn))])


def score(fitted, test: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns with the predicted label ``p`` and, where there are any, class probabilities, as an array and by class."""
    names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
    out = fitted.transform(P.matrix(test, cols))
    chances = F.map_from_arrays(F.transform(names, lambda n: n.cast("int")), F.slice(vector_to_array("probability"), 1, F.size(names)))
    prob = [vector_to_array("probability").alias("prob"), chances.alias("chances")] if "probability" in out.columns else []
    return out.select(*keep, F.get(names, F.col("prediction").cast("int")).cast("int").alias("p"), *prob)


def score_counts(fitted, test: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(y, p, n): ``score`` counted, as a table.  A model in bins is asked once for each kind of row, not for each row."""
    if isinstance(fitted.stages[1], Bucketizer):
        test = kinds(fitted, P.matrix(test, cols), [F.col(label).alias("y")])
        names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
        called = PipelineModel(fitted.stages[2:]).transform(test).select("y", F.get(names, F.col("prediction").cast("int")).cast("int").alias("p"), "n")
    else:
        called = score(fitted, test, cols, [F.col(label).alias("y")]).select("y", "p", F.lit(1).alias("n"))
    return cut(called.groupBy("y", "p").agg(F.sum("n").alias("n")), "score-counts")


def kinds(fitted, rows: DataFrame, by: list) -> DataFrame:
    """``by``, bins and the number ``n`` of such rows."""
    bucket = fitted.stages[1]
    return bucket.transform(rows).groupBy(*by, *bucket.getOutputCols()).agg(F.count("*").alias("n"))


def out_of_fold(df: DataFrame, cols: list[str], label: str, group: str, k: int = 2, keep: list[str] = (), model=None, scaled: bool = False, seed: int = 0) -> DataFrame:
    """Every row scored by a model that has not seen its group."""
    return score_folds(folds(df, cols, label, group, k, keep, seed), cols, label, k, keep, model, scaled)


def folds(df: DataFrame, cols: list[str], label: str, group: str, k: int = 2, keep: list[str] = (), seed: int = 0) -> DataFrame:
    """``keep``, label, features and fold of every row as a table, since a learner reads its rows many times."""
    folded = df.join(P.grouped_folds(df, group, k, label, seed), group)
    return cut(folded.select(*dict.fromkeys([*keep, label, *cols]), "fold"), "folds")


def score_folds(folded: DataFrame, cols: list[str], label: str, k: int = 2, keep: list[str] = (), model=None, scaled: bool = False) -> DataFrame:
    """Every row of ``folds`` scored by a model of the other folds."""
    parts = [score(fit(folded.where(F.col("fold") != f), cols, label, model, scaled), folded.where(F.col("fold") == f), cols, [*keep, F.col(label).alias("y")]) for f in range(k)]
    return reduce(DataFrame.unionByName, parts)


def fold_counts(folded: DataFrame, cols: list[str], label: str, k: int = 2, model=None, scaled: bool = False) -> DataFrame:
    """(y, p, n): ``score_folds`` counted."""
    parts = [score_counts(fit(folded.where(F.col("fold") != f), cols, label, model, scaled), folded.where(F.col("fold") == f), cols, label) for f in range(k)]
    return reduce(DataFrame.unionByName, parts).groupBy("y", "p").agg(F.sum("n").alias("n"))


def out_of_fold_mean(df: DataFrame, cols: list[str], label: str, group: str, key: list[str], seeds=(0, 1, 2), k: int = 2) -> DataFrame:
    """(``key``, y, class, chance): out-of-fold probabilities averaged over fold seeds; ``key`` names a row."""
    return mean_chances(df, cols, label, group, key, seeds, k).select(*key, "y", F.explode("chances").alias("class", "chance"))


def mean_chances(df: DataFrame, cols: list[str], label: str, group: str, key: list[str], seeds=(0, 1, 2), k: int = 2) -> DataFrame:
    """(``key``, y, chances): the same, a map of class to chance in each row.

    One table has the folds of all seeds, and a row meets its models one after another, so nothing is shuffled to be averaged.
    """
    dealt = [P.grouped_folds(df, group, k, label, s).select(group, F.col("fold").alias(f"fold_{s}")) for s in seeds]
    dealt = cut(reduce(lambda a, b: a.join(b, group), dealt), "dealt")
    rows = cut(df.join(dealt, group).select(*dict.fromkeys([*key, label, *cols]), *[f"fold_{s}" for s in seeds]), "folds")
    models = {(s, f): fit(rows.where(F.col(f"fold_{s}") != f), cols, label) for s in seeds for f in range(k)}
    out, carried = P.matrix(rows, cols), [*key, label, *cols, *[f"fold_{s}" for s in seeds]]
    for s in seeds:
        own = F.lit(None)
        for f in range(k):
            names = F.array(*[F.lit(int(x)) for x in models[s, f].stages[0].labels])
            out = models[s, f].transform(out).select(*dict.fromkeys(carried), F.slice(vector_to_array("probability"), 1, F.size(names)).alias(f"c_{s}_{f}"))
            own = F.when(F.col(f"fold_{s}") == f, F.map_from_arrays(names, F.col(f"c_{s}_{f}"))).otherwise(own)
            carried.append(f"c_{s}_{f}")
        out = out.withColumn(f"m_{s}", own)
        carried = [c for c in carried if not c.startswith("c_")] + [f"m_{s}"]
        out = out.select(*dict.fromkeys(carried))
    each = F.array(*[F.map_entries(f"m_{s}") for s in seeds])
    return out.select(*key, F.col(label).alias("y"), F.flatten(each).alias("e")).select(*key, "y", F.map_from_arrays(F.array_distinct("e.key"), F.transform(F.array_distinct("e.key"), _mean_of)).alias("chances"))


def _mean_of(c):
    """The mean of the values of class ``c`` among the entries ``e``."""
    own = F.filter("e", lambda x: x["key"] == c)
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x["value"]) / F.size(own)


def likeliest(chances: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, y, p): the class of the largest mean probability, the smaller one of equals."""
    return chances.groupBy(*key, "y").agg(F.max_by("class", F.struct("chance", -F.col("class"))).alias("p"))


def likeliest_of(chances: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, y, p): the class of the largest mean probability, the smaller one of equals; rows of ``mean_chances``."""
    best = F.array_max(F.transform(F.map_entries("chances"), lambda x: F.struct(x["value"].alias("chance"), (-x["key"]).alias("c"))))
    return chances.select(*key, "y", (-best["c"]).alias("p"))


def importances(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(feature, importance) of a forest of all rows; they sum to 1."""
    found = fit(df, cols, label).stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, found)], "feature string, importance double")  # a row a feature


def benchmark(df: DataFrame, blocks: dict[str, list[str]], label: str, group: str, inert: list[int] = ()) -> DataFrame:
    """Accuracy, macro F1, MCC and macro F1 without the ``inert`` classes of each feature block on identical folds."""
    parts = []
    folded = folds(df, sorted({c for cols in blocks.values() for c in cols}), label, group)
    for name, cols in blocks.items():
        if cols:
            scored = fold_counts(folded, cols, label)
            active = R.scores_of_counts(scored).where(~F.col("class").isin(list(inert))).agg(F.avg("f1").alias("macro_f1_active"))
            parts.append(R.metrics_of_counts(scored).crossJoin(active).select(F.lit(name).alias("block"), "*"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def families(df: DataFrame, cols: list[str], label: str, group: str, counts: bool = False) -> DataFrame:
    """(family, y, p): forest, boosting, perceptron and logistic regression on identical folds; with ``counts`` a row for each
    (family, y, p) and its number n."""
    k = df.select(label).distinct().count() + 1
    makers = {"forest": (forest(), False), "boosting": (OneVsRest(classifier=GBTClassifier(labelCol="idx", maxIter=3, maxDepth=3), labelCol="idx"), False),
              "perceptron": (MultilayerPerceptronClassifier(labelCol="idx", layers=[len(cols), 8, k], maxIter=20, seed=0), True), "logistic": (LogisticRegression(labelCol="idx", maxIter=20), True)}
    folded, names = folds(df, cols, label, group), ["y", "p", "n"] if counts else ["y", "p"]
    parts = [(fold_counts if counts else score_folds)(folded, cols, label, model=m, scaled=s).select(F.lit(n).alias("family"), *names) for n, (m, s) in makers.items()]
    return reduce(DataFrame.unionByName, parts)


def select_in_fold(df: DataFrame, cols: list[str], label: str, group: str, sizes: list[int]) -> DataFrame:
    """(size, macro_f1, features): features ranked by importance inside each training fold, then refitted."""
    folded = folds(df, cols, label, group)
    out = []
    for f in range(2):
        train, test = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        imp = fit(train, cols, label).stages[-1].featureImportances.toArray()
        for n in sizes:
            best = [cols[i] for i in sorted(range(len(cols)), key=lambda i: (-imp[i], cols[i]))[:n]]
            m = R.metrics_of_counts(score_counts(fit(train, best, label), test, best, label))
            out.append(m.select(F.lit(f).alias("fold"), F.lit(n).alias("size"), "macro_f1", F.lit(",".join(sorted(best))).alias("features")))
    return reduce(DataFrame.unionByName, out)


def stability(selected: DataFrame) -> DataFrame:
    """(size, feature, folds): in how many training folds of ``select_in_fold`` a feature was picked."""
    return selected.select("size", F.explode(F.split("features", ",")).alias("feature")).groupBy("size", "feature").agg(F.count("*").alias("folds"))


def best_family(per_class: DataFrame) -> DataFrame:
    """(class, family, f1): the learner with the best F1 of each class, the first by name of equals."""
    return per_class.groupBy("class").agg(F.min(F.struct(-F.col("f1"), "family", "f1")).alias("b")).select("class", "b.family", "b.f1")


def region_arms(obs: DataFrame, target: float, label: str = "label", region: str = "key_region") -> DataFrame:
    """(rule, y, threshold, flagged): one roadside region alone against any region, each at the threshold of the same
    benign false-flag rate.

    A unit's score in a region is its pooled RMSE over that region's receivers; any region flags a unit by its largest.
    """
    station = ["key_seed", "key_claimedStationId"]
    scores = G.claim_fit(obs, [*G.TRIPLE, region]).select(*G.TRIPLE, region, F.col("claim_rmse").alias("score"))
    scores = cut(scores.join(obs.groupBy(*G.TRIPLE).agg(F.mode(label, True).alias("y")), G.TRIPLE), "region-scores")
    parts = []
    for rule, rows in (("per region", scores), ("any region", R.any_region(scores, [*G.TRIPLE, "y"]))):
        t = R.matched_threshold(rows.where("y = 0"), station, target).first()["threshold"]
        rates = R.flag_rates(rows, [*station, "y"], float("inf") if t is None else t)
        parts.append(rates.groupBy("y").agg(F.lit(rule).alias("rule"), F.lit(t).cast("double").alias("threshold"), F.count("*").alias("stations"), F.avg("rate").alias("flagged")))
    return reduce(DataFrame.unionByName, parts)


def cross_scenario(df: DataFrame, scenario: str, cols: list[str], label: str) -> DataFrame:
    """Each scenario scored by a model of the others and by one of its own other rows, equal training sizes."""
    df = cut(df.select(*dict.fromkeys([scenario, "key_rxNodeId", label, *cols])), "scenarios")  # a learner reads its rows many times
    names = sorted(r[0] for r in df.select(scenario).distinct().collect())  # a handful of scenarios
    out = []
    for s in names:
        own, rest = df.where(F.col(scenario) == s), df.where(F.col(scenario) != s)
        test, same = own.where(P.hashed("key_rxNodeId") % 2 == 0), own.where(P.hashed("key_rxNodeId") % 2 == 1)
        n = same.count()
        for arm, train in (("other", cut(P.sample_n(rest, n, "key_rxNodeId"), "scenario-train")), ("same", same)):
            out.append(R.metrics_of_counts(score_counts(fit(train, cols, label), test, cols, label)).select(F.lit(s).alias("scenario"), F.lit(arm).alias("arm"), "*"))
    return reduce(DataFrame.unionByName, out)


def seed_and_time(df: DataFrame, time: str, share: float = 0.5, seed: str = "key_seed") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(train, late, control, held): seeds are held out as well as time, or a model would be asked about stations it knows.

    The last third of the seeds, one at least, is held out; training rows are of the others before the cut, which lies at
    ``share`` of the span of time.  Late rows are of held seeds from the cut on, control rows of the same seeds before it, so that their
    difference is the time's alone.  With one seed it is on both sides, and the control is a training fit.
    """
    seeds = sorted(r[0] for r in df.select(seed).where(F.col(seed).isNotNull()).distinct().collect())  # a row a seed
    held = seeds[-max(1, len(seeds) // 3) :]
    rest = [s for s in seeds if s not in held] or seeds
    low, high = df.agg(F.min(time), F.max(time)).first()
    at = low + (high - low) * share
    early, ours = F.col(time) < at, F.col(seed).isin(held)
    return df.where(F.col(seed).isin(rest) & early), df.where(ours & ~early), df.where(ours & early), df.where(ours)


def temporal(df: DataFrame, time: str, blocks: dict[str, list[str]], label: str, share: float = 0.5, model=None) -> DataFrame:
    """(block, late_f1, control_f1, time_cost, late_mcc, control_mcc, train, late, control) of a model frozen at the cut, by feature block."""
    train, late, control, _ = seed_and_time(df, time, share)
    train, parts = cut(train, "temporal-train"), []
    sizes = [F.lit(x.count()).alias(n) for x, n in ((train, "train"), (late, "late"), (control, "control"))]
    for name, cols in blocks.items():
        fitted = fit(train, cols, label, model)
        a, b = (R.metrics_of_counts(score_counts(fitted, rows, cols, label)).select(F.col("macro_f1").alias(f"{n}_f1"), F.col("mcc").alias(f"{n}_mcc")) for rows, n in ((late, "late"), (control, "control")))
        one = a.crossJoin(b)  # one row each
        parts.append(one.select(F.lit(name).alias("block"), "late_f1", "control_f1", (F.col("late_f1") - F.col("control_f1")).alias("time_cost"), "late_mcc", "control_mcc", *sizes))
    return reduce(DataFrame.unionByName, parts)


def prequential(df: DataFrame, time: str, bins: int, cols: list[str], label: str, share: float = 0.5, least: int = 200, model=None) -> DataFrame:
    """(bin, start, rows, macro_f1, mcc) of a model frozen at the cut over equal bins of the whole span, on held seeds only.

    Bins of fewer than ``least`` rows, or of one class, have null scores.
    """
    train, _, _, held = seed_and_time(df, time, share)
    low, high = df.agg(F.min(time), F.max(time)).first()
    width = (high - low) / bins or 1.0
    rows = held.withColumn("bin", F.floor((F.col(time) - low) / width)).where(F.col("bin") < bins)  # the last moment is the open end
    scored = cut(score(fit(train, cols, label, model), rows, cols, ["bin", F.col(label).alias("y")]).select("bin", "y", "p"), "prequential")
    sizes = scored.groupBy("bin").agg(F.count("*").alias("rows"), F.count_distinct("y").alias("classes"))
    enough = (F.col("rows") >= least) & (F.col("classes") > 1)
    out = sizes.join(R.metrics(scored, ["bin"]), "bin", "left")
    return out.select("bin", (F.lit(low) + F.col("bin") * width).cast("double").alias("start"), "rows", *[F.when(enough, F.col(c)).alias(c) for c in ("macro_f1", "mcc")])


def separability(df: DataFrame, cols: list[str], label: str, classes: list[int], key: str, cap: int | None = None) -> DataFrame:
    """AUC of each class against benign on held-out transmitters, and of relabelled benign stations as control.

    ``cap`` rows a side where it is given, else all.
    """
    def side(rows: DataFrame, y: int) -> DataFrame:
        return (rows if cap is None else P.sample_n(rows, cap, "key_rxNodeId")).withColumn("y", F.lit(y))

    out = []
    for c in [*classes, -1]:
        ben = df.where(F.col(label) == 0)
        pos = ben.where(P.hashed(key, 5) % 2 == 0) if c < 0 else df.where(F.col(label) == c)
        neg = ben.where(P.hashed(key, 5) % 2 == 1) if c < 0 else ben
        both = side(pos, 1).unionByName(side(neg, 0))
        test = P.hashed(key, 9) % 3 == 0
        s = score(fit(both.where(~test), cols, "y"), both.where(test), cols, ["y"]).withColumn("s", F.get("prob", F.lit(1)))
        out.append(R.auc(s, ["s"], "y", [1]).select(F.lit(c).alias("class"), "auc"))
    return reduce(DataFrame.unionByName, out)


def pool_arms(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, arm, p): one receiver picked by hash, majority vote and mean probabilities of one model, on the same units.

    ``scored`` is what ``out_of_fold`` gives for single receivers, with their node id.
    """
    one = F.min_by("p", P.hashed("rxNodeId"))
    hard = scored.groupBy(*keys).agg(F.max("y").alias("y"), one.alias("single"), F.mode("p", True).alias("vote"))
    each = scored.select(*keys, F.explode("chances").alias("class", "chance")).groupBy(*keys, "class").agg(F.avg("chance").alias("chance"))
    soft = each.groupBy(*keys).agg(F.max_by("class", F.struct("chance", -F.col("class"))).alias("soft"))
    arm = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).cast("int").alias("p")) for n, c in (("single", "single"), ("vote", "vote"), ("vote-soft", "soft"))]))
    return hard.join(soft, keys).select(*keys, "y", arm.alias("a")).select(*keys, "y", "a.arm", "a.p")


def pooled_units(obs: DataFrame, cols: list[str], keys: list[str], label: str, group: str) -> tuple[DataFrame, list[str], list[str]]:
    """A row a unit with the means of all features (``pm_``) and the consensus block (``pool_``), and both column lists."""
    means = G.pool_means(obs, cols)
    means = means.select(*keys, *[c for c in means.columns if c.startswith("pm_")])
    block = fits.consensus(obs)
    block = block.select(*keys, *[F.col(c).alias(f"pool_{c}") for c in block.columns if c not in keys])
    truth = obs.groupBy(*keys).agg(F.mode(label, True).alias(label), F.mode(group, True).alias(group))
    whole = cut(truth.join(means, keys).join(block, keys), "pooled-units")
    return whole, [c for c in whole.columns if c.startswith("pm_")], [c for c in whole.columns if c.startswith("pool_")]


def all_arms(obs: DataFrame, cols: list[str], keys: list[str], label: str, group: str, k: int = 2, seed: int = 0, singles: bool = True) -> DataFrame:
    """Metrics of the six ways to use a unit's receivers, on identical folds by transmitter.

    Single receiver, vote and soft vote share one model of single receivers; pooled mean, consensus alone and
    pooled consensus have a model of whole units each.  Without ``singles`` only those three.
    """
    whole, means, block = pooled_units(obs, cols, keys, label, group)
    arms = {"pooled-mean": means, "consensus-only": block, "pooled-consensus": means + block}
    parts = [out_of_fold(whole, c, label, group, k, keys, seed=seed).select(*keys, "y", F.lit(n).alias("arm"), "p") for n, c in arms.items()]
    if singles:
        parts.append(pool_arms(out_of_fold(obs, cols, label, group, k, [*keys, "rxNodeId"], seed=seed), keys))
    return R.metrics(reduce(DataFrame.unionByName, parts), ["arm"])


def receiver_sweep(obs: DataFrame, cols: list[str], keys: list[str], label: str, group: str, sizes: list[int]) -> DataFrame:
    """The pooled arms with at most so many receivers a unit, picked by hash.

    Fewer receivers are the first of more: each pick is written once and read by the next, and by all that its arms gather.
    """
    kept, parts = obs, []
    for n in sorted(sizes, reverse=True):
        kept = cut(P.per_key(kept, keys, n, "rxNodeId"), "sweep-receivers")
        parts.append(all_arms(kept, cols, keys, label, group, singles=False).select(F.lit(n).alias("receivers"), "*"))
    return reduce(DataFrame.unionByName, parts)
