"""Corpus hygiene, splits and samples.  Every random choice is a hash order, so reruns agree."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import hash_rank

STATION = ["key_seed", "label_txNodeId"]
PRINT_BUCKETS = 1024


def hashed(key, seed: int = 0) -> Column:
    """A multiplicative hash of an integer key that any SQL engine can repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return (key * 2654435761 + seed * 40503) % 4294967296


def clean(df: DataFrame) -> DataFrame:
    return df.where("label_clean = 1") if "label_clean" in df.columns else df


def feature_columns(df: DataFrame, prefixes=("app_", "phy_")) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def check_features(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Fails unless the feature columns are exactly those wanted."""
    extra, missing = set(feature_columns(df)) - set(wanted), set(wanted) - set(feature_columns(df))
    if extra or missing:
        raise ValueError(f"extra features {sorted(extra)}, missing {sorted(missing)}")
    return df


def blocks_of(df: DataFrame, claim_based: list[str] = ()) -> dict[str, list[str]]:
    """Feature blocks: app, phy, fused, and the radio ones that never read the claim."""
    app, phy = feature_columns(df, ["app_"]), feature_columns(df, ["phy_"])
    return {"app": app, "phy": phy, "fused": app + phy, "radio": [c for c in phy if c not in claim_based],
            "pooled": feature_columns(df, ["pm_"]), "consensus": feature_columns(df, ["pool_"])}


def matrix(df: DataFrame, features: list[str], fill: float = 0.0) -> DataFrame:
    """Features as floats with null, NaN and infinities replaced."""
    inf = F.lit(float("inf"))
    done = {f: F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f)) == inf), F.lit(fill)).otherwise(F.col(f)).cast("float") for f in features}
    return df.withColumns(done)


def by_role(df: DataFrame, role: str, column: str = "key_observer_role") -> tuple[DataFrame, DataFrame]:
    """Rows of an observer role, and (kept, total)."""
    return df.where(F.col(column) == role), df.agg(F.count_if(F.col(column) == role).alias("kept"), F.count("*").alias("total"))


def seed_offset(tag, block: int = 100_000) -> Column:
    """Id block of a seed: the trailing integer of its tag; a tag without one fails loudly as null."""
    digits = F.regexp_extract(tag if isinstance(tag, Column) else F.col(tag), r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("long") * block)


def rebase(df: DataFrame, id_col: str, block: int = 100_000) -> DataFrame:
    """Ids moved into their seed's block; fails if ids of a seed span blocks already, if a tag has no number, or if
    two seeds would share a block."""
    spans = df.groupBy("key_seed").agg(F.count_distinct(F.floor(F.col(id_col) / block)).alias("n")).where("n > 1").limit(1).collect()
    if spans:
        raise ValueError(f"ids of seed {spans[0][0]} span several blocks")
    blocks = df.select("key_seed").distinct().groupBy(seed_offset("key_seed", block).alias("at")).agg(F.count("*").alias("n"), F.min("key_seed").alias("seed"))
    clash = blocks.where("n > 1 OR at IS NULL").limit(1).collect()
    if clash:
        raise ValueError(f"seed {clash[0]['seed']} has no block of its own")
    return df.withColumn(id_col, F.pmod(F.col(id_col), F.lit(block)) + seed_offset("key_seed", block))


def shared_features(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in feature_columns(a, ["app_", "phy_", "pool_"]) if c in b.columns]


def union_corpora(a: DataFrame, b: DataFrame, prefix: str, ids: list[str]) -> DataFrame:
    """Two corpora on their shared columns, the second's seeds prefixed and its ids above the first's."""
    tops = a.agg(*[F.max(c).alias(c) for c in ids]).first()
    bump = {c: F.col(c) + F.lit((tops[c] or 0) + 1) for c in ids}
    shared = [c for c in a.columns if c in b.columns]
    moved = b.withColumns(bump).withColumn("key_seed", F.concat(F.lit(prefix), "key_seed"))
    return a.select(*shared).unionByName(moved.select(*shared))


def copies(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(feature, label) pairs that are equal in every row: label copies."""
    pairs = [(f, l) for f in features for l in labels]
    same = df.agg(*[F.bool_and(F.col(f).cast("double").eqNullSafe(F.col(l).cast("double"))).alias(f"c{k}") for k, (f, l) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(l).alias("label"), F.col(f"c{k}").alias("same")) for k, (f, l) in enumerate(pairs)]))
    return same.select(each.alias("e")).select("e.*")


def on_road(df: DataFrame, halfwidth: float) -> DataFrame:
    """Per station: share of its rows on the road, and whether it is always, never or sometimes there."""
    g = df.groupBy("claimedStationId").agg(F.avg((F.abs("claimedY") <= halfwidth).cast("int")).alias("share"))
    return g.withColumn("kind", F.when(F.col("share") == 1, "on").when(F.col("share") == 0, "off").otherwise("mixed"))


def attach_split(df: DataFrame, splits: DataFrame, keys: list[str], complete: bool = False) -> DataFrame:
    """Rows with their frozen split; rows without one keep null, or fail where the split must be ``complete``."""
    out = df.join(splits.select(*keys, "split").dropDuplicates(keys), keys, "left")
    if complete:
        lost = out.where("split IS NULL").select(*keys).limit(3).collect()
        if lost:
            raise ValueError(f"no split for {[tuple(r) for r in lost]}")
    return out


def held_out(df: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the ids, all others)."""
    return df.join(ids, keys, "left_semi"), df.join(ids, keys, "left_anti")


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys two tables share; disjoint tables give 0."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("shared"))


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if overlap_count(a, b, keys).first()[0]:
        raise ValueError(f"tables share {keys}")


def fingerprint(tx: DataFrame) -> DataFrame:
    """A digest of the first benign position of every sender, per seed: equal digests are one scenario twice.

    Senders are digested in hash buckets that grow with their number, then the buckets' digests together.
    """
    first = tx.where("attackId = 0").groupBy("key_seed", "txNodeId").agg(F.min(F.struct("txTimeMs", "msgUid", "trueX", "trueY")).alias("p"))
    spot = F.concat_ws(":", F.col("txNodeId"), F.rint(F.col("p.trueX") * 100).cast("long"), F.rint(F.col("p.trueY") * 100).cast("long"))
    some = first.select("key_seed", spot.alias("spot"), (hashed("txNodeId") % PRINT_BUCKETS).alias("bucket"))
    parts = some.groupBy("key_seed", "bucket").agg(F.sha1(F.concat_ws(",", F.sort_array(F.collect_list("spot")))).alias("part"))
    # at most ``PRINT_BUCKETS`` digests a seed
    return parts.groupBy("key_seed").agg(F.sha1(F.concat_ws(",", F.sort_array(F.collect_list("part")))).alias("print"))


def require_distinct_prints(prints: DataFrame) -> DataFrame:
    """Fails if two seeds have one fingerprint."""
    twice = prints.groupBy("print").agg(F.min("key_seed").alias("a"), F.max("key_seed").alias("b")).where("a < b").limit(1).collect()
    if twice:
        raise ValueError(f"seeds {twice[0]['a']} and {twice[0]['b']} are one scenario")
    return prints


def require_no_twins(a: DataFrame, b: DataFrame, most: float = 0.5) -> DataFrame:
    """The share of positions two inputs have in common; fails over ``most``."""
    out = twin_share(a, b)
    share = out.first()["share"]
    if share is not None and share > most:
        raise ValueError(f"{share:.0%} of the positions are shared")
    return out


def twin_share(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of rounded positions two inputs have in common, of the smaller one."""
    def spots(df):
        return df.select(F.rint("trueX").alias("x"), F.rint("trueY").alias("y")).distinct()
    x, y = spots(a), spots(b)
    both = x.join(y, ["x", "y"], "left_semi").agg(F.count("*").alias("common"))
    sizes = x.agg(F.count("*").alias("na")).crossJoin(y.agg(F.count("*").alias("nb"))).crossJoin(both)  # one row each
    return sizes.select("common", (F.col("common") / F.least("na", "nb")).alias("share"))


def own_error(tx: DataFrame, window_ms: float) -> DataFrame:
    """Mean own positioning error per vehicle and window; liars borrow the series of an honest donor."""
    w = F.floor(F.col("txTimeMs") / window_ms).alias("window")
    own = tx.groupBy("txNodeId", w).agg(F.avg(F.col("claimedX") - F.col("trueX")).alias("ex"), F.avg(F.col("claimedY") - F.col("trueY")).alias("ey"), F.max("attackId").alias("attack"))
    kinds = own.groupBy("txNodeId").agg(F.max("attack").alias("attack"))
    ranked = hash_rank(kinds.withColumn("honest", F.col("attack") == 0), ["honest"], hashed("txNodeId"), ["txNodeId"], "r", "n").withColumn("r", F.col("r") - 1)  # one row a vehicle
    donors = ranked.where("honest").select(F.col("txNodeId").alias("donor"), F.col("r").alias("dr"))
    n = donors.count()
    lent = ranked.where("NOT honest").select("txNodeId", (F.col("r") % max(n, 1)).alias("dr")).join(donors, "dr").select("txNodeId", "donor")
    series = own.select(F.col("txNodeId").alias("donor"), "window", F.col("ex").alias("dx"), F.col("ey").alias("dy"))
    full = own.join(lent, "txNodeId", "left").join(series, ["donor", "window"], "left")
    honest = F.col("attack") == 0
    return full.select("txNodeId", "window", F.when(honest, F.col("ex")).otherwise(F.col("dx")).alias("ex"), F.when(honest, F.col("ey")).otherwise(F.col("dy")).alias("ey"))


def station_table(df: DataFrame) -> DataFrame:
    return df.groupBy(*STATION).agg(F.min("label_attackId").alias("label_attackId"), F.count("*").alias("windows"), F.count_distinct("key_claimedStationId").alias("claimed_ids"))


def expand(st: DataFrame, df: DataFrame) -> DataFrame:
    """Every claimed identity with the row of its transmitter."""
    return df.select(*STATION, "key_claimedStationId").distinct().join(st, STATION, "left")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label_attackId").agg(F.count_distinct(*STATION).alias("stations"), F.count("*").alias("windows"))


def pivot_counts(st: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Stations by row and column value, zeros filled in."""
    return st.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"c{v}") for v in values])


def multi(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys with more than one value of a column."""
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("n")).where("n > 1")


def assign(st: DataFrame, fractions=(0.6, 0.2), seed: int = 0) -> DataFrame:
    """Train, validation and test per station, stratified by class; each is non-empty from three stations on."""
    st = hash_rank(st, ["label_attackId"], hashed("label_txNodeId", seed), ["key_seed", "label_txNodeId"], "r", "n")
    tr, va = F.rint(F.col("n") * fractions[0]), F.rint(F.col("n") * fractions[1])
    st = st.withColumn("tr", F.when(F.col("n") >= 3, F.greatest(F.lit(1.0), F.least(tr, F.col("n") - 2))).otherwise(tr))
    st = st.withColumn("va", F.when(F.col("n") >= 3, F.greatest(F.lit(1.0), F.least(va, F.col("n") - F.col("tr") - 1))).otherwise(va))
    split = F.when(F.col("r") <= F.col("tr"), "train").when(F.col("r") <= F.col("tr") + F.col("va"), "validation").otherwise("test")
    return st.withColumn("split", split).drop("r", "n", "tr", "va")


def grouped_folds(df: DataFrame, group: str, k: int, y: str | None = None, seed: int = 0) -> DataFrame:
    """(group, fold): no group in two folds; with ``y``, classes are dealt in turn so that folds balance."""
    if y is None:  # by hash alone: no sort of all groups
        return df.select(group).distinct().select(group, (hashed(group, seed) % k).cast("int").alias("fold"))
    groups = df.groupBy(group).agg(F.mode(y, True).alias("y"))
    ranked = hash_rank(groups, ["y"], hashed(group, seed), [group], "r", "n")
    return ranked.select(group, ((F.col("r") - 1) % k).cast("int").alias("fold"))


#: Rows of a sample that one task may sort.
TOP = 10_000


def sample_n(df: DataFrame, n: int, key, seed: int = 0) -> DataFrame:
    """``n`` rows by hash order of a key: a top-n, reproducible.

    A large sample is cut by counts of 4,096 hash ranges: those that it holds whole stay where they are, and only the
    rows of the one range at its end are sorted.
    """
    if n <= TOP:
        return df.orderBy(hashed(key, seed), key).limit(n)
    part = F.coalesce(F.shiftright(hashed(key, seed).cast("long"), 20), F.lit(-(1 << 40)))  # nulls come first
    before = 0
    for r in sorted(df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a range
        if before + r.n >= n:
            return df.where(part < r.part).unionByName(df.where(part == r.part).orderBy(hashed(key, seed), key).limit(n - before))
        before += r.n
    return df


def balanced(df: DataFrame, share: float, observer: str, key: str, seed: int = 0) -> DataFrame:
    """All attack rows and an equal fraction of each observer's benign rows, at least one each."""
    n = df.agg(F.count_if(F.col("label_attackId") > 0).alias("a"), F.count_if(F.col("label_attackId") == 0).alias("b")).first()
    want = min(round(share / (1 - share) * n["a"]), n["b"])
    frac = want / max(n["b"], 1)
    benign = hash_rank(df.where("label_attackId = 0"), [observer], hashed(key, seed), [key, *[c for c in df.columns if c.startswith("key_")]], "__rank", "__of", bits=8)
    kept = benign.where(F.col("__rank") <= F.greatest(F.lit(1.0), F.rint(F.col("__of") * frac))).drop("__rank", "__of")
    return df.where("label_attackId > 0").unionByName(kept)


def holdout(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Keys whose hash falls under a fraction: a share of stations without sorting them."""
    return df.select(key).distinct().where(hashed(key, seed) < fraction * 4294967296)


def per_key(df: DataFrame, keys: list[str], k: int, by, seed: int = 0) -> DataFrame:
    """At most ``k`` rows of each key, by hash order; up to 1,000 Spark cuts every key to ``k`` rows before the shuffle."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(hashed(by, seed), by))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def thin(df: DataFrame, client: str, cap: int, key: str, least: int = 20, seed: int = 0) -> DataFrame:
    """Every client thinned by the same fraction so that the total comes near ``cap``, ``least`` rows staying."""
    f = min(1.0, cap / max(df.count(), 1))
    r = hash_rank(df, [client], hashed(key, seed), [key], "__rank", "__of", bits=8)
    return r.where(F.col("__rank") <= F.greatest(F.lit(float(least)), F.floor(F.col("__of") * f))).drop("__rank", "__of")


def clients(df: DataFrame, column: str, least: int, seed: int = 0) -> DataFrame:
    """(client, n, part): clients with enough rows, dealt about 70/15/15 by hash; no sort of all clients."""
    g = df.groupBy(F.col(column).alias("client")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    share = hashed("client", seed) / 4294967296
    part = F.when(share < 0.7, "train").when(share < 0.85, "validation").otherwise("test")
    return g.select("client", "n", part.alias("part"))


def client_parts(df: DataFrame, splits: DataFrame, client: str, least: int) -> DataFrame:
    """Rows with their ``part`` by the frozen split of transmitters: every client with at least ``least`` train rows trains
    on them, validation and test rows count wherever they were heard.

    Fails where a transmitter is in two parts or a row has none.
    """
    twice = multi(splits, STATION, "split").limit(1).collect()
    if twice:
        raise ValueError(f"in more than one part: {tuple(twice[0])}")
    rows = attach_split(df, splits, STATION, complete=True).withColumnRenamed("split", "part")
    enough = rows.where("part = 'train'").groupBy(client).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(client)
    train = rows.where("part = 'train'").join(enough, client, "left_semi")
    return train.unionByName(rows.where("part <> 'train'"))


def holdout_tx(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Transmitters held out within each class."""
    tx = df.groupBy("label_txNodeId").agg(F.mode("label_attackId", True).alias("class"))
    r = hash_rank(tx, ["class"], hashed("label_txNodeId", seed), ["label_txNodeId"], "r", "n")
    return r.where(F.col("r") <= F.ceil(F.col("n") * fraction)).select("label_txNodeId", "class")


#: Distribution function of Poisson(1), as far as 32-bit hashes can tell its tail.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def bootstrap(df: DataFrame, n: int, cluster: str, value: str) -> DataFrame:
    """(replicate, mean): cluster bootstrap by hashed Poisson weights, so no resample is materialised.

    ``cluster`` is an integer column: stations, or whole seeds by number.  A replicate in which no cluster is drawn has a null mean.
    """
    per = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    rep = per.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    # two rounds of a hash that any SQL engine can repeat, then the number of steps of the distribution function below it
    u = hashed(F.floor(hashed(F.col(cluster) * 7919 + F.col("replicate") * 104729) / 4096), 1) / 4294967296
    w = reduce(lambda x, y: x + y, [(u >= p).cast("int") for p in POISSON])
    return rep.groupBy("replicate").agg(F.try_divide(F.sum(F.col("s") * w), F.sum(F.col("c") * w)).alias("mean"))


def overlap_share(picked: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Share of the test keys that were picked."""
    p = picked.select(key).distinct().withColumn("hit", F.lit(1))
    return test.select(key).distinct().join(p, key, "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def shared_classes(frames: list[DataFrame], column: str = "label_attackId") -> DataFrame:
    """(class, corpora, shared) over several corpora."""
    tagged = reduce(DataFrame.unionByName, [f.select(column).distinct().withColumn("corpus", F.lit(k)) for k, f in enumerate(frames)])
    return tagged.groupBy(column).agg(F.count("*").alias("corpora")).withColumn("shared", F.col("corpora") == len(frames))


def missing(got: DataFrame, column: str, expected: list, by: str) -> DataFrame:
    """(by, value) combinations of the expected values that have no row."""
    grid = got.select(by).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in expected])))
    return grid.join(got.select(by, column).distinct(), [by, column], "left_anti")


def card_counts(df: DataFrame) -> DataFrame:
    """Facts of a corpus in one pass, one row each."""
    row = df.agg(F.count("*").alias("windows"), F.count_distinct(*STATION).alias("transmitters"), F.count_if(F.col("label_attackId") == 0).alias("benign"),
                 F.count_distinct("key_claimedStationId").alias("identities"), F.count_distinct("label_attackId").alias("classes"), F.count_distinct("key_seed").alias("seeds"))
    return row.unpivot([], row.columns, "fact", "value")
