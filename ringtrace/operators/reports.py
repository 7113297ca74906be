"""Metrics, operating points, tracks, drift and update aggregation as grouped jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import cut
from .asof import gaps
from .quantiles import quantile_numbers, with_quantiles
from .ranks import running_before


# ---- detection metrics
def confusion(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] = ()) -> DataFrame:
    return pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def class_scores(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every class that occurs, from the K x K counts."""
    return scores_of_counts(_counted(pred, by), by)


def _counted(pred: DataFrame, by: list[str]) -> DataFrame:
    """The counts as a table: they are read several times, and whatever model stands behind them is asked once."""
    return cut(confusion(pred, by=by), "confusion")


def scores_of_counts(c: DataFrame, by: list[str] = ()) -> DataFrame:
    """``class_scores`` from the counts that ``confusion`` gives."""
    y = c.groupBy(*by, F.col("y").alias("class")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("hit"))
    p = c.groupBy(*by, F.col("p").alias("class")).agg(F.sum("n").alias("called"))
    j = y.join(p, [*by, "class"], "full")
    hit = F.coalesce("hit", F.lit(0))
    prec, rec = F.coalesce(F.try_divide(hit, F.col("called")), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.col("actual")), F.lit(0.0))
    return j.select(*by, "class", prec.alias("precision"), rec.alias("recall"), F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"))


def metrics(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro F1 and multiclass Matthews correlation."""
    return metrics_of_counts(_counted(pred, by), by)


def metrics_of_counts(c: DataFrame, by: list[str] = ()) -> DataFrame:
    """``metrics`` from the counts that ``confusion`` gives."""
    s = c.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("c"))
    y = c.groupBy(*by, F.col("y").alias("class")).agg(F.sum("n").alias("t"))
    p = c.groupBy(*by, F.col("p").alias("class")).agg(F.sum("n").alias("q"))
    m = y.join(p, [*by, "class"], "full").na.fill(0, ["t", "q"])
    m = m.groupBy(*by).agg(F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    f1 = scores_of_counts(c, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(b))  # without keys each side is one row
    j = join(join(s, m), f1)
    ss = F.col("s").cast("double") * F.col("s")
    mcc = F.try_divide(F.col("c").cast("double") * F.col("s") - F.col("tq"), F.sqrt(ss - F.col("qq")) * F.sqrt(ss - F.col("tt")))
    return j.select(*by, F.try_divide("c", "s").alias("accuracy"), "macro_f1", F.coalesce(mcc, F.lit(0.0)).alias("mcc"))


def threshold_table(scores: DataFrame, ts: list[float], prevalence: float, decisions_per_hour: float) -> DataFrame:
    """False positive rate, recall, precision and MCC per threshold, as measured and at a given prevalence."""
    e = scores.select("y", "score", F.explode(F.array(*[F.lit(t) for t in ts])).alias("t"))
    hit = F.col("score") >= F.col("t")
    g = e.groupBy("t").agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & (F.col("y") == 1)), ("fp", hit & (F.col("y") == 0)), ("fn", ~hit & (F.col("y") == 1)), ("tn", ~hit & (F.col("y") == 0)))])

    def mcc(tp, fp, fn, tn):
        return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))

    g = g.withColumn("fpr", F.col("fp") / F.greatest(F.lit(1.0), F.col("fp") + F.col("tn"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("fn")))
    a, b = F.col("recall") * prevalence, F.col("fpr") * (1 - prevalence)
    return g.select("t", "fpr", "recall", (F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("fp"))).alias("precision"),
                    F.coalesce(mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]), F.lit(0.0)).alias("mcc"), F.try_divide(a, a + b).alias("precision_at"),
                    mcc(a, b, (1 - F.col("recall")) * prevalence, (1 - F.col("fpr")) * (1 - prevalence)).alias("mcc_at"), (F.col("fpr") * decisions_per_hour).alias("alerts_per_hour"))


def decisions(df: DataFrame, keys: list[str], station: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_distinct(station).alias("n"))
    return g.agg(F.percentile("n", F.lit(0.5)).alias("median"))


def auc(df: DataFrame, features: list[str], label: str, classes: list) -> DataFrame:
    """(feature, class, auc) of one feature for one class against the rest; ties count half.

    Rows are counted by feature and value first, and values add up in two levels.
    """
    arms = [F.count_if(F.col(label) == c).alias(f"p{k}") for k, c in enumerate(classes)]
    each = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("e"))
    g = each.where("e.v IS NOT NULL").groupBy("e.feature", "e.v").agg(F.count("*").alias("n"), *arms)
    g = running_before(g, ["feature"], "v", F.col("n"), "before").withColumn("below", F.col("before") + (F.col("n") + 1) / 2)
    sums = g.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(classes))], *[F.sum(F.col("below") * F.col(f"p{k}")).alias(f"r{k}") for k in range(len(classes))])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p{k}").alias("p"), F.col(f"r{k}").alias("r")) for k, c in enumerate(classes)])).alias("a")
    s = sums.select("feature", "n", one)
    return s.select("feature", "a.class", F.try_divide(F.col("a.r") - F.col("a.p") * (F.col("a.p") + 1) / 2.0, F.col("a.p") * (F.col("n") - F.col("a.p"))).alias("auc"))


def matched_threshold(scores: DataFrame, station: list[str], target: float) -> DataFrame:
    """Smallest score v whose mean per-station share of rows over v is at most the target."""
    w = scores.groupBy(*station).agg(F.count("*").alias("rows"))
    n = w.count()
    each = scores.join(w, station).groupBy("score").agg(F.sum(1.0 / (F.lit(float(n)) * F.col("rows"))).alias("w"))
    return running_before(each, [], "score", F.col("w"), "above", descending=True).where(F.col("above") <= target).agg(F.min("score").alias("threshold"))


def plausibility(train: DataFrame, test: DataFrame, checks: dict[str, tuple[str, str]], fpr: float, label: str) -> DataFrame:
    """Share of each class that every check fires on, thresholds from benign training rows, and their union."""
    tail = {n: [fpr / 2, 1 - fpr / 2] if side == "both" else [1 - fpr if side == "hi" else fpr] for n, (c, side) in checks.items()}
    columns = {c: F.col(c) for c, _ in checks.values()}
    found = quantile_numbers(train.where(F.col(label) == 0), columns, {f"{n}{k}": (checks[n][0], q) for n, qs in tail.items() for k, q in enumerate(qs)})
    cuts = {n: [F.lit(found[f"{n}{k}"]).cast("double") for k in range(len(qs))] for n, qs in tail.items()}
    fired = {}
    for n, (c, side) in checks.items():
        t = cuts[n]
        cond = (F.col(c) < t[0]) | (F.col(c) > t[1]) if side == "both" else F.col(c) > t[0] if side == "hi" else F.col(c) < t[0]
        fired[n] = F.coalesce(cond, F.lit(False))
    any_ = F.lit(False)
    for c in fired.values():
        any_ = any_ | c
    return test.groupBy(label).agg(*[F.avg(c.cast("int")).alias(n) for n, c in (fired | {"any": any_}).items()])


# ---- tracks
def k_of_m(df: DataFrame, track: list[str], order: list[str], k: int, m: int, whole: bool = False) -> DataFrame:
    """Adds ``fired``: at least k hits among the last m windows; with ``whole`` only once m windows are there."""
    w = Window.partitionBy(*track).orderBy(*order).rowsBetween(-(m - 1), 0)
    fired = F.sum(F.col("hit").cast("int")).over(w) >= k
    return df.withColumn("fired", fired & (F.count("*").over(w) == m) if whole else fired)


def episodes(df: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Rising edges of ``fired``, whether any, and the length of each track."""
    w = Window.partitionBy(*track).orderBy(*order)
    edge = F.col("fired") & ~F.coalesce(F.lag("fired").over(w), F.lit(False))
    e = df.withColumn("edge", edge)
    return e.groupBy(*track).agg(F.count_if("edge").alias("episodes"), F.bool_or("fired").alias("found"), F.count("*").alias("length"), F.bool_or("attack").alias("attack"))


def contact_time(tracks: DataFrame) -> DataFrame:
    b = S.cut_bins("length", [0, 4, 8, 12, 16, 100])
    return tracks.groupBy(b.alias("bin")).agg(F.count_if("attack").alias("attack_tracks"), F.avg(F.when(F.col("attack"), F.col("found").cast("int"))).alias("found"), F.avg(F.when(~F.col("attack"), F.col("found").cast("int"))).alias("flagged"))


def found_by(tracks: DataFrame, by: Column) -> DataFrame:
    return tracks.groupBy(by.alias("class")).agg(F.count("*").alias("tracks"), F.avg(F.col("found").cast("int")).alias("found"))


def family_scores(pred: DataFrame) -> DataFrame:
    """Flagged and correctly named shares per attack family, of attacks without a family, and of benign rows (false alarms)."""
    fam = S.code_map("y", S.FAMILY)
    named = S.code_map("p", S.FAMILY)
    return pred.groupBy(F.coalesce(fam, F.when(F.col("y") == 0, "benign").otherwise("other")).alias("family")).agg(F.avg((F.col("p") != 0).cast("int")).alias("flagged"), F.avg(F.coalesce((named == fam).cast("int"), F.lit(0))).alias("named"))


def vote(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Receivers, flags, alert and the most common named class for each station and second."""
    flagged = F.col("p") != 0
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flagged).alias("k"), F.mode(F.when(flagged, F.col("p")), True).alias("top"))
    return g.withColumn("alert", F.col("k") >= F.ceil(F.col("n") * share))


def matched_vote(votes: DataFrame, pooled: DataFrame, shares: list[float]) -> DataFrame:
    """For each seed the smallest vote share whose false alarms on the other seeds are at most the pooled ones."""
    e = votes.where("NOT attack").select("seed", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "k", "n")
    per = e.groupBy("seed", "share").agg(F.count_if(F.col("k") >= F.ceil(F.col("n") * F.col("share"))).alias("alarms"))
    target = pooled.where("NOT attack").groupBy("seed").agg(F.count_if("flag").alias("alarms"))
    seeds = target.select(F.col("seed").alias("out"))  # one row a seed
    # the other seeds' alarms are all seeds' less the own ones; a seed alone has nothing to be fitted on
    total = per.groupBy("share").agg(F.sum("alarms").alias("all"), F.count_distinct("seed").alias("n"))
    whole = target.agg(F.sum("alarms").alias("whole"))
    each = seeds.crossJoin(total).crossJoin(whole)  # the given shares, and one row
    own = per.select(F.col("seed").alias("out"), "share", F.col("alarms").alias("own"))
    goal = target.select(F.col("seed").alias("out"), F.col("alarms").alias("mine"))
    j = each.join(own, ["out", "share"], "left").join(goal, "out").where(F.col("n") > F.col("own").isNotNull().cast("int"))
    fits = F.col("all") - F.coalesce("own", F.lit(0)) <= F.col("whole") - F.col("mine")
    return j.where(fits).groupBy(F.col("out").alias("seed")).agg(F.min("share").alias("share"))


def flag_rates(units: DataFrame, keys: list[str], t: float) -> DataFrame:
    return units.groupBy(*keys).agg(F.avg((F.col("score") > t).cast("int")).alias("rate"), F.count("*").alias("windows"))


def any_region(units: DataFrame, keys: list[str]) -> DataFrame:
    return units.groupBy(*keys).agg(F.max("score").alias("score"))


def detection_curve(det: DataFrame, edges: list[float], least: int) -> DataFrame:
    """Share of stations caught by displacement band [lo, hi), bands with enough stations."""
    return det.groupBy(S.digitize("offset", edges).alias("band")).agg(F.count("*").alias("stations"), F.avg("rate").alias("rate"), F.avg((F.col("rate") > 0.5).cast("int")).alias("caught")).where(F.col("stations") >= least)


def rank_avg(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average rank with ties, by value counts."""
    g = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_before(g, keys, value, F.col("n"), "__below").withColumn("rank", F.col("__below") + (F.col("n") + 1) / 2).drop("__below")


def last_per_frame(df: DataFrame, keys: list[str], time: str, order: str, width: float, cols: list[str]) -> DataFrame:
    return df.groupBy(*keys, S.window_index(time, width).alias("frame")).agg(F.max(F.struct(time, order, *cols)).alias("m")).select(*keys, "frame", *[F.col(f"m.{c}").alias(c) for c in cols])


def resample(frames: DataFrame, keys: list[str], value: str, road_length: float | None = None, slice_of: int | None = None) -> DataFrame:
    """Every frame between a key's first and last, gaps interpolated linearly along the short way of a ring.

    With ``slice_of`` frames a key is cut into slices, sorted apart; the first row of the slice after is carried in.
    """
    rows = frames.withColumn("__s", F.lit(0) if slice_of is None else F.floor(F.col("frame") / slice_of))
    w = Window.partitionBy(*keys, "__s").orderBy("frame")
    rows = rows.withColumn("__n", F.lead(F.struct("frame", F.col(value).alias("v"))).over(w))
    if slice_of is not None:
        copies = [f"__k{n}" for n in range(len(keys))]
        starts = rows.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, copies)], F.col("__s").alias("__t")).agg(F.min_by(F.struct("frame", F.col(value).alias("v")), "frame").alias("__first"))
        starts = starts.withColumn("__first", F.lead("__first").over(Window.partitionBy(*copies).orderBy("__t")))  # a row a slice
        same = F.col("__s").eqNullSafe(F.col("__t"))
        for k, c in zip(keys, copies):
            same = same & F.col(k).eqNullSafe(F.col(c))
        rows = rows.join(starts, same, "left").withColumn("__n", F.coalesce("__n", "__first"))
    nxt = rows.withColumn("__next", F.col("__n.frame")).withColumn("__step", S.unwrap(F.col("__n.v") - F.col(value), road_length))
    f = nxt.withColumn("f", F.explode(F.sequence(F.col("frame"), F.coalesce(F.col("__next") - 1, F.col("frame")))))
    at = F.col(value) + F.coalesce(F.col("__step") * (F.col("f") - F.col("frame")) / (F.col("__next") - F.col("frame")), F.lit(0.0))
    at = at if road_length is None else F.pmod(at, F.lit(float(road_length)))
    return f.select(*keys, F.col("f").alias("frame"), at.alias(value), (F.col("f") != F.col("frame")).alias("gap"))


def forward_fill(df: DataFrame, keys: list[str], time: str, order: str, column: str, horizon: float | None = None, slice_of: float | None = None) -> DataFrame:
    """Adds ``<column>_held``: the latest value not null, if not older than the horizon.

    With ``slice_of``, a length of time, rows are sorted inside a key's slices of it only, and the last value of the slices
    before is carried in.
    """
    value = F.when(F.col(column).isNotNull(), F.struct(F.col(time).alias("t"), F.col(column).alias("v")))
    rows = df.withColumn("__s", F.lit(0) if slice_of is None else F.floor(F.col(time) / slice_of))
    w = Window.partitionBy(*keys, "__s").orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("__l", F.last(value, True).over(w))
    if slice_of is not None:
        copies = [f"__k{n}" for n in range(len(keys))]
        ends = rows.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, copies)], F.col("__s").alias("__t")).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(time, order))).alias("__end"))
        along = Window.partitionBy(*copies).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        ends = ends.withColumn("__end", F.last("__end", True).over(along))
        same = F.col("__s").eqNullSafe(F.col("__t"))
        for k, c in zip(keys, copies):
            same = same & F.col(k).eqNullSafe(F.col(c))
        held = held.join(ends, same, "left").withColumn("__l", F.coalesce("__l", "__end")).drop("__end", "__t", *copies)
    held = held.drop("__s")
    fresh = F.lit(True) if horizon is None else F.col(time) - F.col("__l.t") <= horizon
    return held.withColumn(f"{column}_held", F.when(fresh, F.col("__l.v"))).drop("__l")


def running_scores(pred: DataFrame, second: Column) -> DataFrame:
    """Cumulative hits over replay time; the window sees one row a second."""
    g = pred.groupBy(second.alias("second")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("p")).alias("hit"))
    w = Window.orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("second", "n", F.sum("n").over(w).alias("seen"), (F.sum("hit").over(w) / F.sum("n").over(w)).alias("accuracy"))


def share(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    g = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


# ---- comparison of corpora
def partition_skew(df: DataFrame, client: str, label: str) -> DataFrame:
    """Effective classes and distance from the pooled class shares, per client."""
    per = share(df, label, [client]).select(client, label, "share")
    pooled = share(df, label).select(label, F.col("share").alias("pool"))
    k = pooled.agg(F.count("*").alias("k"))
    j = per.join(pooled, label)
    g = j.groupBy(client).agg(F.sum(S.entropy_terms("share")).alias("e"), F.sum(F.abs(F.col("share") - F.col("pool"))).alias("d"), F.sum("pool").alias("seen"), F.count("*").alias("present"))
    # classes a client lacks differ from the pool by their whole share
    return g.crossJoin(k).select(client, F.exp("e").alias("effective"), (F.col("k") - F.col("present")).alias("missing"), ((F.col("d") + 1 - F.col("seen")) / 2).alias("tv"))


def feature_shift(a: DataFrame, b: DataFrame, features: list[str]) -> DataFrame:
    """Absolute mean difference in standard deviations of the first corpus, largest first."""
    def long(df, pre):
        s = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias(f"m{pre}"), F.col(f"s_{c}").alias(f"s{pre}")) for c in features])).alias("e")).select("e.*")
    j = long(a, "a").join(long(b, "b"), "feature")
    return j.select("feature", F.abs(F.try_divide(F.col("mb") - F.col("ma"), F.col("sa"))).alias("shift")).orderBy(F.desc("shift"), "feature")


def pool_separation(df: DataFrame, stats: list[str], label: str) -> DataFrame:
    """Median of each class against benign, in benign standard deviations."""
    each = df.select(label, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in stats])).alias("e")).select(label, "e.*")
    g = with_quantiles(each.groupBy("stat", label).agg(F.stddev_samp("v").alias("s")), each, ["stat", label], {"v": F.col("v")}, {"m": ("v", 0.5)})
    g = cut(g, "separation")  # a row a class and statistic
    ben = g.where(F.col(label) == 0).select("stat", F.col("m").alias("bm"), F.col("s").alias("bs"))
    return g.where(F.col(label) != 0).join(ben, "stat").select("stat", label, F.try_divide(F.col("m") - F.col("bm"), F.col("bs")).alias("shift"))


def refit_scaling(train: DataFrame, target: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """Target rows standardised by the target's own statistics and rescaled to the training ones."""
    def stats(df):
        return df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    a, b = stats(train), stats(target)
    return target.select(*key, *[((F.col(c) - b[f"m{k}"]) / (b[f"s{k}"] or 1.0) * a[f"s{k}"] + a[f"m{k}"]).alias(c) for k, c in enumerate(features)])


# ---- campaign reports
def receiver_counts(units: DataFrame) -> DataFrame:
    q = quantile_numbers(units, {"n": F.col("n")}, {"median": ("n", 0.5), "p25": ("n", 0.25), "p10": ("n", 0.1)})
    g = units.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg((F.col("n") < 80).cast("int")).alias("thin"))
    numbers = {k: F.lit(v).cast("double") for k, v in q.items()}
    return g.select(*[v.alias(k) for k, v in numbers.items()], "least", "most", "thin", *[F.ceil(numbers["median"] / k).alias(f"colluders_{k}") for k in (2, 3, 4)])


def magnitude_ladder(tx: DataFrame) -> DataFrame:
    """Lies per class: messages beyond the largest benign error, per-station median, quartiles, share inside the benign p95."""
    e = tx.withColumn("err", F.hypot(F.col("claimedX") - F.col("trueX"), F.col("claimedY") - F.col("trueY")))
    b = quantile_numbers(e.where("attackId = 0"), {"e": F.col("err")}, {"m": ("e", 1.0), "q": ("e", 0.95)})
    top, p95 = (b["m"] or 0.0), (b["q"] or 0.0)
    st = e.where((F.col("attackId") > 0) & (F.col("err") > top)).groupBy("attackId", "txNodeId").agg(F.percentile("err", F.lit(0.5)).alias("lie"))
    st = cut(st, "ladder")
    stats = st.groupBy("attackId").agg(F.count("*").alias("stations"), F.avg((F.col("lie") <= p95).cast("int")).alias("inside_benign"))
    return with_quantiles(stats, st, ["attackId"], {"lie": F.col("lie")}, {"p25": ("lie", 0.25), "p50": ("lie", 0.5), "p75": ("lie", 0.75)})


def carriageway_share(tx: DataFrame, widths: list[float], window_ms: float) -> DataFrame:
    """Share of station windows and of messages beyond each half-width, by class."""
    each = tx.withColumn("w", S.window_index("txTimeMs", window_ms))
    g = each.groupBy("claimedStationId", "w").agg(F.avg("claimedY").alias("y"), F.min("attackId").alias("attackId"), (F.max("claimedX") - F.min("claimedX")).alias("span"), F.count("*").alias("n"))
    wd = F.explode(F.array(*[F.lit(float(w)) for w in widths])).alias("width")
    sw = g.where("span <= 1000").select("attackId", "y", wd).groupBy("attackId", "width").agg(F.count("*").alias("windows"), F.avg((F.abs("y") > F.col("width")).cast("int")).alias("windows_outside"))
    ms = each.select("attackId", "claimedY", wd).groupBy("attackId", "width").agg(F.avg((F.abs("claimedY") > F.col("width")).cast("int")).alias("messages_outside"))
    return sw.join(ms, ["attackId", "width"])


def sybil_residual(units: DataFrame, value: str, count: str, label: str) -> DataFrame:
    """Excess of the attackers' residual over benign, and the part their channel counts explain."""
    x, y, ben = F.log(count), F.col(value), F.col(label) == 0
    q = quantile_numbers(units, {"b": F.when(ben, y), "s": F.when(~ben, y), "x": F.when(~ben, x)}, {"mb": ("b", 0.5), "ms": ("s", 0.5), "mx": ("x", 0.5)})
    f = units.agg(F.regr_slope(F.when(ben, y), F.when(ben, x)).alias("b"), F.regr_intercept(F.when(ben, y), F.when(ben, x)).alias("a"), F.corr(F.when(ben, x), F.when(ben, y)).alias("r"))
    f = f.select("*", *[F.lit(v).cast("double").alias(k) for k, v in q.items()])
    # the prediction is monotone in x, so its median is the prediction at the median
    return f.select("a", "b", "r", (F.col("ms") - F.col("mb")).alias("excess"), (F.col("a") + F.col("b") * F.col("mx") - F.col("mb")).alias("explained"))


def binned_mean(df: DataFrame, x: Column, edges: list[float], **values: Column) -> DataFrame:
    """Means by (lo, hi] bin: reception ratio by distance, error rate by SINR and the like."""
    return df.groupBy(S.cut_bins(x, edges).alias("bin")).agg(F.count("*").alias("n"), *[F.avg(v.cast("double")).alias(k) for k, v in values.items()])


def cbr_summary(tx: DataFrame) -> DataFrame:
    span = (F.max("txTimeMs") - F.min("txTimeMs")) / 1000.0
    q = quantile_numbers(tx, {"c": F.col("txCbr")}, {"median": ("c", 0.5), "p95": ("c", 0.95)})
    stats = tx.agg(F.avg("txCbr").alias("mean"), F.max("txCbr").alias("most"), (F.count("*") / F.count_distinct("txNodeId") / span).alias("rate"))
    return stats.select("mean", *[F.lit(v).cast("double").alias(k) for k, v in q.items()], "most", "rate")


def station_offsets(tx: DataFrame) -> DataFrame:
    e = F.hypot(F.col("claimedX") - F.col("trueX"), F.col("claimedY") - F.col("trueY"))
    return tx.groupBy("key_seed", "txNodeId").agg(F.max("attackId").alias("attackId"), F.percentile(e, F.lit(0.5)).alias("offset"))


def sharing_cost(tx: DataFrame, window_ms: float, sizes: list[int]) -> DataFrame:
    """Reports a second, and megabits a second for each report size."""
    span = (F.max("txTimeMs") - F.min("txTimeMs")) / 1000.0
    g = tx.groupBy("claimedStationId", S.window_index("txTimeMs", window_ms).alias("w")).agg(F.count("*").alias("n"), F.min("txTimeMs").alias("txTimeMs"))
    return g.agg((F.count("*") / span).alias("reports_per_s"), F.percentile("n", F.lit(0.5)).alias("messages"), *[(F.count("*") / span * 8 * b / 1e6).alias(f"mbit_{b}") for b in sizes])


def upload_cost(units: DataFrame, region: str, minutes: float, bytes_per_row: int, model_bytes: int) -> DataFrame:
    g = units.groupBy(region).agg((F.count("*") * bytes_per_row / minutes).alias("rate"))
    return g.agg(*[F.percentile("rate", F.lit(q)).alias(n) for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))], (F.lit(float(model_bytes)) / F.avg("rate")).alias("break_even_minutes"))


def campaign_summary(tx: DataFrame, slice_ms: float = 60_000.0) -> DataFrame:
    """Message mix and sending gaps by class."""
    g = gaps(tx, ["txNodeId"], "txTimeMs", slice_ms, ["msgUid"])
    stats = g.groupBy("attackId").agg(F.count("*").alias("n"), F.count_distinct("txNodeId").alias("stations"), *[F.count_if(F.col("msgType") == c).alias(S.MESSAGE[c].lower()) for c in (1, 2, 14)],
                                      F.avg("gap").alias("gap_mean"), F.count_distinct("gap").alias("gaps"))
    return with_quantiles(stats, g, ["attackId"], {"gap": F.col("gap")}, {"gap_median": ("gap", 0.5)})


def benign_error(tx: DataFrame) -> DataFrame:
    b = tx.where("attackId = 0").select("txNodeId", F.hypot(F.col("claimedX") - F.col("trueX"), F.col("claimedY") - F.col("trueY")).alias("e"), F.abs(S.signed_angle(F.col("claimedHeading") - F.col("trueHeading"))).alias("h"), F.abs(F.col("claimedSpeed") - F.col("trueSpeed")).alias("s"))
    means = b.groupBy("txNodeId").agg(F.avg("e").alias("m"))
    q = quantile_numbers(b, {"e": F.col("e"), "h": F.col("h")}, {"median": ("e", 0.5), "p95": ("e", 0.95), "heading": ("h", 0.5)})
    q |= quantile_numbers(means, {"m": F.col("m")}, {"station_p25": ("m", 0.25), "station_p50": ("m", 0.5), "station_p75": ("m", 0.75)})
    stats = b.agg(F.max("e").alias("most"), F.count_if(F.col("e") == 0).alias("zero"), F.max("s").alias("speed"))
    return stats.select("*", *[F.lit(v).cast("double").alias(k) for k, v in q.items()])


# ---- update aggregation
def aggregate_updates(updates: DataFrame, rule: str = "weighted", clip: float = 1.0, momentum: float = 0.9) -> DataFrame:
    """(dim, value): client updates averaged by rows, by work-normalised steps, or clipped and uniform."""
    long = updates.select("client", "n_rows", "n_steps", F.posexplode("vector").alias("dim", "v"))
    if rule == "weighted":
        return long.groupBy("dim").agg((F.sum(F.col("n_rows") * F.col("v")) / F.sum("n_rows")).alias("value"))
    if rule == "normalised":
        rho, t = momentum, F.col("n_steps")
        work = (t - rho * (1 - F.pow(F.lit(rho), t)) / (1 - rho)) / (1 - rho)
        s = long.withColumn("work", work).groupBy("dim").agg((F.sum(F.col("n_rows") * F.col("work")) / F.sum("n_rows")).alias("w"), (F.sum(F.col("n_rows") * F.col("v") / F.col("work")) / F.sum("n_rows")).alias("d"))
        return s.select("dim", (F.col("w") * F.col("d")).alias("value"))
    if rule != "clipped":
        raise ValueError(f"unknown rule {rule}")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = updates.select(F.least(F.lit(1.0), F.lit(clip) / (norm + 1e-12)).alias("f"), F.posexplode("vector").alias("dim", "v"))
    return scaled.groupBy("dim").agg(F.avg(F.col("f") * F.col("v")).alias("value"))


def prototypes(updates: DataFrame) -> DataFrame:
    """Per-class means over the clients that hold the class, weighted by their rows."""
    return updates.select("class", "n_rows", F.posexplode("vector").alias("dim", "v")).groupBy("class", "dim").agg((F.sum(F.col("n_rows") * F.col("v")) / F.sum("n_rows")).alias("value"))


def server_step(updates: DataFrame, rate: float = 1.0) -> DataFrame:
    """Adaptive server step from zero state: the mean update over its own magnitude."""
    moved = serve(aggregate_updates(updates, "weighted"), None, "adam", rate)
    return moved.select("dim", (-F.col("value")).alias("value"))


def serve(gradient: DataFrame, state: DataFrame | None, optimiser: str = "adam", rate: float = 1.0, beta1: float = 0.9, beta2: float = 0.99, tau: float = 1e-3) -> DataFrame:
    """(dim, value, m, v): the server's model after one step along a round's pseudo-gradient (dim, value), with its carried state.

    ``state`` is what the round before returned; None is a zero model without momentum, and a dimension missing on either side
    counts as zero there.  ``avgm`` adds momentum; with ``beta1`` 0 and rate 1 it is the plain average.  ``adam`` scales each weight,
    without bias correction.
    """
    if optimiser not in ("avgm", "adam"):
        raise ValueError(f"unknown optimiser {optimiser}")
    rows = gradient.select("dim", F.col("value").alias("d"))
    if state is None:
        rows = rows.select("dim", "d", *[F.lit(0.0).alias(c) for c in ("x", "m0", "v0")])
    else:
        rows = rows.join(state.select("dim", F.col("value").alias("x"), F.col("m").alias("m0"), F.col("v").alias("v0")), "dim", "full").fillna(0.0, ["d", "x", "m0", "v0"])
    if optimiser == "avgm":
        rows = rows.withColumn("m", beta1 * F.col("m0") + F.col("d")).withColumn("v", F.lit(0.0)).withColumn("step", F.col("m"))
    else:
        rows = rows.withColumn("m", beta1 * F.col("m0") + (1 - beta1) * F.col("d")).withColumn("v", beta2 * F.col("v0") + (1 - beta2) * F.col("d") * F.col("d"))
        rows = rows.withColumn("step", F.col("m") / (F.sqrt("v") + tau))
    return rows.select("dim", (F.col("x") - rate * F.col("step")).alias("value"), "m", "v")


def serve_rounds(updates: DataFrame, round_of: Column, rounds: int, optimiser: str = "adam", **settings: float) -> DataFrame:
    """``serve`` over ``rounds`` rounds of sample-weighted updates, the state being written between them."""
    state = None
    for k in range(rounds):
        state = cut(serve(aggregate_updates(updates.where(round_of == k), "weighted"), state, optimiser, **settings), "server-state")
    return state
