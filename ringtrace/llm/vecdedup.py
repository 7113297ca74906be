"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one node.  A pass sorts the nodes by label and by a string of random
hyperplane signs around the label's centre, compares every node with the next ``window`` nodes in
double precision and emits a spanning forest of the links found.  Passes use independent
hyperplanes.

How many passes a label needs is measured, not assumed.  In a sorted pass the prefix of a node is the
shortest one whose run fits the window; a pair at the threshold meets if both share it.  The angle
between the two as seen from the label's centre is bounded by their distance and the node's
distance from the centre, so every node gets a probability of meeting, however its label is
shaped.  Labels get passes until the mean chance that a threshold pair is missed by all is ``miss`` at
most.  Crowded nodes, in surroundings so dense that they would need over ``EASY`` passes and over twice
their label's median, are compared with all nodes of the label instead, in bins, which is exact; so are
all nodes of a label for which passes would cost more than that.

Links of all passes are united by distributed components.  Windows are bounded, groups need not be:
``n_links`` of a component are counted over all its pairs.  Nodes within half the threshold's angle of
their component's centre are proven to be linked with each other and are counted at once; only pairs with a
node outside are compared, in bins of at most ``chunk`` nodes, and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _matrix, number_type, usable
from .components import connected_components
from .shared import cut, drop

BITS = 62
#: Nodes that need up to as many passes are never crowded.
EASY = 12
#: A bound for the count of needed passes, far over any that is run.
MOST = 1_000_000


def _signs(seed: int, dims: int):
    import numpy as np

    return np.random.default_rng(1000 + seed).normal(size=(dims, BITS))


def _unit(x):
    import numpy as np

    big = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component, so that no square overflows or vanishes
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(nodes: DataFrame) -> dict[tuple[int, int], object]:
    """Mean unit vector of each (label, length): one partial sum a task and label, then one grouped sum."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: dict[int, list] = {}
        for batch in batches:
            x, label = _unit(_matrix(batch.column(1))), np.asarray(batch.column(0))
            for k in np.unique(label):
                mine = label == k
                held = sums.setdefault(int(k), [0, np.zeros(x.shape[1])])
                held[0] += int(mine.sum())
                held[1] = held[1] + x[mine].sum(axis=0)
        cols = [pa.array(list(sums), pa.int32()), pa.array([h[0] for h in sums.values()], pa.int64()), pa.array([h[1] for h in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, ["label", "n", "s"])

    out: dict[tuple[int, int], object] = {}
    for dims in [r["n"] for r in nodes.select(F.size("v").alias("n")).distinct().collect()]:  # a row a length
        parts = nodes.where(F.size("v") == dims).select("label", "v").mapInArrow(run, "label int, n long, s array<double>")
        each = parts.select("label", "n", F.posexplode("s")).groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
        for r in each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("s") / F.col("n")))).alias("m")).collect():  # a row a label
            out[r["label"], dims] = np.array([p[1] for p in r["m"]])
    return out


def _keyed(nodes: DataFrame, seed: int, centres) -> DataFrame:
    kind = nodes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            label = np.asarray(batch.column(1))
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            key = np.empty(len(label), np.int64)
            for dims in np.unique(sizes):
                some = np.flatnonzero(sizes == dims)
                x = _unit(_matrix(batch.column(2).take(pa.array(some))))
                x = x - np.stack([centres[int(k), int(dims)] for k in label[some]])
                key[some] = (x @ _signs(seed, int(dims)) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], ["node", "label", "v", "key"])

    return nodes.select("node", "label", "v").mapInArrow(run, f"node long, label int, v {kind}, key long")


def _pass(nodes: DataFrame, seed: int, centres, rows: int, window: int, threshold: float, miss: float) -> DataFrame:
    """One sorted pass, by partition: links (a, b), a spanning forest of those between rows at most ``window``
    apart; lines (label, n, need): ``n`` nodes of a label that would need ``need`` passes like this one; and
    lines (a, label, need): the nodes of them that would need more than ``EASY``."""
    parts = ceil(rows / 50_000) + 3
    kept = max(0.5, 1 - window * parts / rows)  # pairs that no border of a task parts
    length = F.size("v")
    ordered = _keyed(nodes, seed, centres).withColumn("size", length).repartitionByRange(parts, "label", "size", "key", "node")
    ordered = ordered.sortWithinPartitions("label", "size", "key", "node").select("node", "label", "v", "key", "size")
    chord = (2 - 2 * threshold) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        up: dict[int, int] = {}
        needs: dict[tuple[int, int], int] = {}

        def top(n: int) -> int:
            while up.get(n, n) != n:
                up[n] = up.get(up[n], up[n])
                n = up[n]
            return n

        tail = None
        for batch in _same_size(batches):
            node, label, key = (np.asarray(batch.column(k)) for k in (0, 1, 3))
            x = _unit(_matrix(batch.column(2)))
            far = np.linalg.norm(x - np.stack([centres[int(k), x.shape[1]] for k in label]), axis=1)
            angle = np.where(far > chord, np.arcsin(np.minimum(1, chord / np.maximum(far, 1e-300))), np.pi)
            old = 0
            if tail is not None and tail[2].shape[1] == x.shape[1]:
                old = len(tail[0])
                node, label, x, key, angle = (np.concatenate(p) for p in zip(tail, (node, label, x, key, angle)))
            links: list[tuple[int, int]] = []
            for at in range(0, len(node), 512):
                a, b = slice(at, at + 512), slice(at, min(len(node), at + 512 + window))
                near = (x[a] @ x[b].T >= threshold) & (label[a][:, None] == label[b][None])
                i, j = np.nonzero(np.triu(near, 1) & ~np.triu(near, window + 1))
                new = j + at >= old
                links += zip(node[at + i[new]].tolist(), node[at + j[new]].tolist())
            # bits a partner must share: one more than the row just outside the window shares
            apart = np.zeros(len(node), np.int64)
            for d in (window + 1, -window - 1):
                there = np.arange(len(node)) + d
                fine = (there >= 0) & (there < len(node))
                there = there[fine]
                same = np.zeros(len(node), np.int64)
                mixed = np.maximum(np.bitwise_xor(key[fine], key[there]), 1)
                common = BITS - 1 - np.floor(np.log2(mixed)).astype(np.int64)
                same[fine] = np.where(label[fine] == label[there], common + 1, 0)
                apart = np.maximum(apart, same)
            meet = kept * np.clip(1 - angle / np.pi, 1e-9, 1 - 1e-9) ** np.minimum(apart, BITS)
            need = np.ceil(np.minimum(MOST, np.log(miss) / np.log1p(-np.minimum(meet, 1 - miss / 10)))).astype(np.int64)
            mine = np.arange(len(node)) >= old
            each, many = np.unique(np.stack([label, need])[:, mine], axis=1, return_counts=True)
            for (k, grade), n in zip(each.T.tolist(), many.tolist()):
                needs[k, grade] = needs.get((k, grade), 0) + n
            crowded = np.flatnonzero(mine & (need > EASY))
            made = []
            for p, q in links:
                p, q = top(p), top(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    made.append((p, q))
            yield _lines(made, list(zip(*(c[crowded].tolist() for c in (node, label, need)))), {})
            tail = (node[-window:], label[-window:], x[-window:], key[-window:], angle[-window:])
        yield _lines([], [], needs)

    return ordered.mapInArrow(run, "a long, b long, label int, n long, need int")


def _lines(links: list[tuple[int, int]], crowded: list[tuple[int, int, int]], needs: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Links, crowded nodes and counts of needed passes as rows of one table."""
    rows = [(a, b, None, None, None) for a, b in links] + [(a, None, k, None, need) for a, k, need in crowded]
    rows += [(None, None, k, n, need) for (k, need), n in needs.items()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "label", "n", "need"])


def _same_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the length of the vectors changes."""
    import numpy as np

    for batch in batches:
        size = np.asarray(batch.column(4))
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
        for p, q in zip(edges, edges[1:]):
            if q > p:
                yield batch.slice(p, q - p)


def passes_needed(needs: list[tuple[int, int]], miss: float) -> int:
    """Passes until the mean chance of a miss is ``miss``, for counts (need, n): a node of need ``p`` is missed by
    all of ``r`` passes with probability miss ** (r / p)."""
    total = sum(n for _, n in needs)
    low, high = 1, max(p for p, _ in needs)
    while low < high:
        r = (low + high) // 2
        if sum(n * miss ** (r / p) for p, n in needs) <= miss * total:
            high = r
        else:
            low = r + 1
    return low


def _compared(members: DataFrame, chunk: int, threshold: float, forest: bool) -> DataFrame:
    """All pairs of nodes of equal ``grp`` that are not proven alike, in bins.

    ``members`` is (grp, core, node, label, copies, v); no two nodes with ``core`` are compared.  Small groups
    share bins.  The result is (node, links), the weight of the nodes found linked, or with
    ``forest`` a spanning forest (a, b) of the links of every two bins.
    """
    nth = F.xxhash64("node")
    sizes = members.groupBy("grp", "core").agg(F.count("*").alias("n"))
    most = sizes.groupBy("grp").agg(F.sum("n").alias("all"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shared = max(1, ceil(total / chunk))
    small = F.col("all") <= chunk
    plan = sizes.join(most, "grp").select(
        F.col("grp").alias("g"), F.col("core").alias("k"), small.alias("small"), F.ceil(F.col("n") / chunk).cast("int").alias("bins")
    )
    plan = cut(plan, "vec-plan")
    big = plan.where("NOT small").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).select("g", F.struct("k", "c").alias("e"))
    meet = big.withColumnRenamed("e", "i").join(big.withColumnRenamed("e", "j"), "g").where("i <= j AND NOT (i.k AND j.k)")
    meet = cut(meet.withColumn("u", F.xxhash64("g", "i", "j")), "vec-meets")
    ends = meet.select("g", "u", F.col("i").alias("e"), F.lit(True).alias("first"), (F.col("i") == F.col("j")).alias("same"))
    ends = ends.union(meet.where("i <> j").select("g", "u", "j", F.lit(False), F.lit(False)))
    rows = members.join(plan, (F.col("grp") == F.col("g")) & (F.col("core") == F.col("k")))
    cols = ["grp", "core", "node", "label", "copies", "v"]
    packed = rows.where("small").select(F.pmod(F.xxhash64("grp"), F.lit(shared)).alias("u"), F.lit(True).alias("first"), F.lit(True).alias("same"), *cols)
    dealt = rows.where("NOT small").select("g", F.struct("k", F.pmod(nth, F.col("bins")).cast("int").alias("c")).alias("e"), *cols).join(ends, ["g", "e"])
    dealt = packed.withColumn("small", F.lit(True)).union(dealt.select("u", "first", "same", *cols, F.lit(False)))

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        grp, core, node, label, copies, first = (np.asarray(table.column(k)) for k in ("grp", "core", "node", "label", "copies", "first"))
        sizes = np.diff(np.asarray(table.column("v").combine_chunks().offsets))
        ones, twos = np.flatnonzero(first), np.flatnonzero(~first)
        within = bool(np.asarray(table.column("same"))[0])
        if within:
            twos = ones
        counts = np.zeros(len(node), np.int64)
        links = []
        order = np.argsort(sizes, kind="stable")
        for dims in np.unique(sizes):
            a, b = (k[sizes[k] == dims] for k in (ones, twos))
            if not len(a) or not len(b):
                continue
            x = np.zeros((len(node), int(dims)))
            some = order[sizes[order] == dims]
            x[some] = _unit(_matrix(table.column("v").combine_chunks().take(pa.array(some))))
            for at in range(0, len(a), 1024):
                p = a[at : at + 1024]
                near = (x[p] @ x[b].T >= threshold) & (label[p][:, None] == label[b][None]) & (grp[p][:, None] == grp[b][None])
                near &= ~(core[p][:, None] & core[b][None])
                if within:
                    near &= p[:, None] != b[None]
                counts[p] += near @ copies[b]
                if not within:
                    counts[b] += near.T @ copies[p]
                if forest:
                    i, j = np.nonzero(near)
                    links += zip(node[p[i]].tolist(), node[b[j]].tolist())
        if not forest:
            return pa.table({"node": table.column("node"), "links": pa.array(counts, pa.int64())})
        up: dict[int, int] = {}
        made = []

        def top(n: int) -> int:
            while up.get(n, n) != n:
                up[n] = up.get(up[n], up[n])
                n = up[n]
            return n

        for p, q in links:
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                made.append((p, q))
        return pa.table({n: pa.array([m[k] for m in made], pa.int64()) for k, n in enumerate("ab")})

    units = dealt.groupBy("small", "u")
    if forest:
        return units.applyInArrow(run, "a long, b long")
    return units.applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _links_of(members: DataFrame, chunk: int, threshold: float) -> DataFrame:
    """(node, links): for every node of (root, node, label, copies, v) the weight of the nodes of its component it links to."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > chunk).select("root"), "vec-large")
    if large.isEmpty():
        return _compared(members.select(F.col("root").alias("grp"), F.lit(False).alias("core"), "node", "label", "copies", "v"), chunk, threshold, False)
    half = acos(threshold) / 2 - 1e-6
    kind = members.schema["v"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            root = np.asarray(batch.column(0))
            x = _unit(_matrix(batch.column(1)))
            each, where = np.unique(root, return_inverse=True)
            sums = np.zeros((len(each), x.shape[1]))
            np.add.at(sums, where, x)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(list(sums), pa.list_(pa.float64()))], ["root", "s"])

    held = members.join(large, "root")
    parts = held.select("root", "v").mapInArrow(partial, "root long, s array<double>")
    middle = parts.select("root", F.posexplode("s")).groupBy("root", "pos").agg(F.sum("col").alias("s"))
    middle = middle.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("middle"))
    middle = cut(middle, "vec-middles")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x, m = _matrix(batch.column(4)), batch.column(5)
            core = np.zeros(len(x), bool)
            there = np.flatnonzero(np.asarray(m.is_valid()))
            if len(there):
                c = _matrix(m.take(pa.array(there)))
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                core[there] = (_unit(x[there]) * c).sum(axis=1) >= np.cos(half)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(core)], ["grp", "node", "label", "copies", "v", "core"])

    rows = members.join(middle, "root", "left").select("root", "node", "label", "copies", "v", "middle")
    rows = cut(rows.mapInArrow(mark, f"grp long, node long, label int, copies long, v {kind}, core boolean"), "vec-marked")
    inside = rows.where("core").groupBy("grp").agg(F.sum("copies").alias("weight"))
    proven = rows.where("core").join(inside, "grp").select("node", (F.col("weight") - F.col("copies")).alias("links"))
    return _compared(rows, chunk, threshold, False).union(proven).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    window: int = 256,
    chunk: int = 1024,
    miss: float = 1e-3,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Only vectors of equal, non-null labels and equal lengths are compared, as they are given, in double
    precision.  Unusable vectors, null ids and null labels link with nothing: n_links 0, their own
    component, kept.  Rows that repeat an id with the same vector and label are one vector.  The number of labels is small
    against the rows: a centre of each is held by the tasks.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("int").alias("label"),
        F.col(vector_col).cast(f"array<{number_type(vectors, vector_col)}>").alias("v"),
    )
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    rows = cut(rows.withColumn("key", F.when(fit, F.struct("label", "v"))), "vec-rows")
    each = rows.where("key IS NOT NULL").select("vec_id", "key").distinct()
    classes = each.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = cut(classes.select("node", "key.label", "key.v", "copies"), "vec-nodes")
    sizes = {r["label"]: r["n"] for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    plain = F.coalesce(F.col("copies") - 1, F.lit(0))
    if sizes:
        tables = _all_passes(nodes, sizes, window, chunk, threshold, miss)
        links = [t.where("b IS NOT NULL").select("a", "b") for t in tables]
        groups = cut(connected_components(reduce(DataFrame.union, links)), "vec-groups")
        for t in tables:
            drop(t)
        members = cut(nodes.join(groups, "node"), "vec-members")
        nodes = (
            nodes.join(groups, "node", "left")
            .join(_links_of(members, chunk, threshold), "node", "left")
            .select("label", "v", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        )
    else:
        nodes = nodes.select("label", "v", "copies", F.col("node").alias("root"), F.lit(0).alias("links"))
    nodes = nodes.select(F.struct("label", "v").alias("key"), "copies", "root", "links")
    joined = rows.select("vec_id", "key").join(nodes, "key", "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        (plain + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _all_passes(nodes: DataFrame, sizes: dict[int, int], window: int, chunk: int, threshold: float, miss: float) -> list[DataFrame]:
    """Tables with links (a, b): as many passes as each label needs, and the comparison of crowded nodes."""
    centres = _centres(nodes)
    found = [cut(_pass(nodes, 0, centres, sum(sizes.values()), window, threshold, miss), "vec-pass")]
    needs: dict[int, list[tuple[int, int]]] = {}
    for r in found[0].where("n IS NOT NULL").groupBy("label", "need").agg(F.sum("n").alias("n")).collect():  # grades a label
        needs.setdefault(r["label"], []).append((r["need"], r["n"]))
    wanted, limit = {}, {}
    for label, grades in needs.items():
        grades.sort()
        half, run = sum(n for _, n in grades) / 2, 0
        for need, n in grades:
            run += n
            if run >= half:
                break
        limit[label] = max(EASY, 2 * need)
        wanted[label] = passes_needed([g for g in grades if g[0] <= limit[label]], miss)
        if wanted[label] > 4 * ceil(sizes[label] / chunk) + 16:  # a node is sent to ceil(n / chunk) bins
            wanted[label], limit[label] = 1, 0
    for seed in range(1, max(wanted.values())):
        togo = [label for label, n in wanted.items() if n > seed]
        part = nodes if len(togo) == len(sizes) else nodes.where(F.col("label").isin(togo))
        links = _pass(part, seed, centres, sum(sizes[k] for k in togo), window, threshold, miss).where("b IS NOT NULL")
        found.append(cut(links, "vec-pass"))
    bounds = F.create_map(*[F.lit(v) for kv in limit.items() for v in kv])
    crowded = found[0].where("a IS NOT NULL AND b IS NULL").where(F.col("need") > bounds[F.col("label")])
    crowded = cut(crowded.select("label", F.col("a").alias("node")), "vec-crowded")
    labels = {r["label"] for r in crowded.select("label").distinct().collect()} | {k for k, v in limit.items() if v == 0}  # a row a label
    if labels:
        alone = [k for k, v in limit.items() if v == 0]
        some = nodes.where(F.col("label").isin(list(labels))).join(crowded.select("node", F.lit(False).alias("core")), "node", "left")
        core = F.coalesce("core", ~F.col("label").isin(alone))
        found.append(cut(_compared(some.select(F.col("label").cast("long").alias("grp"), core.alias("core"), "node", "label", "copies", "v"), chunk, threshold, True), "vec-bins"))
    return found
