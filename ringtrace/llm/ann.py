"""Nearest neighbours by score-aware anisotropic quantisation.

Ranking by Euclidean distance is a maximum inner product search: |x|^2 / 2 - q.x, where the norm is
kept exactly and q.x is what quantisation disturbs.  Error of x along x itself changes large
inner products most, so the code of a vector minimises perpendicular error plus ``ratio`` times
parallel error: codes are chosen by coordinate descent over the subspaces, codebooks by exact
solutions of the weighted least-squares problem, one subspace after another.  Each subspace has
16 code words (4 bits); two codes share a byte.  For a query the inner products with all code words
make a table, and a scan adds up table entries.  The best of every unit of rows are ranked again
by the exact distance on the original vectors.

Rows are dealt to coarse cells, and a query scans its nearest cells only.  How many is measured: a sample of
the queries is compared with all rows, and the fewest cells are probed that hold ``reach`` of their
true neighbours, up to all cells.  A cell is split into units by a hash, so a hot cell is many tasks.
Codebooks and cells are fitted on a bounded sample; every row is encoded and filed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SUBSPACES = 32
#: Rows and queries that meet in a task.
UNIT_ROWS, UNIT_QUERIES = 16_384, 2048


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def number_type(frame: DataFrame, vector_col: str) -> str:
    """``float`` for a column of floats, else ``double``: vectors are compared as they are given."""
    kind = getattr(frame.schema[vector_col].dataType, "elementType", None)
    return "float" if kind is not None and kind.simpleString() == "float" else "double"


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, copies): the usable vectors of the most common length whose id is not null.

    Rows alike in id and vector are one line with a count.
    """
    kind = number_type(vectors, vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = cut(rows.groupBy("id", "v").agg(F.count("*").alias("copies")), "ann-rows")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == sizes["n"]) if sizes else rows


def _matrix(column: pa.Array):
    import numpy as np

    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _padded(x):
    import numpy as np

    more = -x.shape[1] % SUBSPACES
    return np.pad(x, ((0, 0), (0, more))) if more else x


def _assign(x, books, ratio: float, sweeps: int = 2):
    """Codes of the rows of ``x``: nearest code words first, then coordinate descent on the weighted loss."""
    import numpy as np

    n = len(x)
    parts = x.reshape(n, SUBSPACES, -1)
    norm = np.linalg.norm(x, axis=1)
    unit = (x / np.where(norm > 0, norm, 1)[:, None]).reshape(parts.shape)
    square = np.empty((SUBSPACES, n, 16))
    along = np.empty((SUBSPACES, n, 16))
    for m in range(SUBSPACES):
        square[m] = ((parts[:, m, None, :] - books[m][None]) ** 2).sum(axis=2)
        along[m] = unit[:, m] @ books[m].T
    codes = square.argmin(axis=2).T.copy()
    rows = np.arange(n)
    got = sum(along[m][rows, codes[:, m]] for m in range(SUBSPACES))
    for _ in range(sweeps):
        for m in range(SUBSPACES):
            rest = norm - (got - along[m][rows, codes[:, m]])
            best = (square[m] + (ratio - 1) * (rest[:, None] - along[m]) ** 2).argmin(axis=1)
            got += along[m][rows, best] - along[m][rows, codes[:, m]]
            codes[:, m] = best
    return codes


def fit_codebooks(x, ratio: float = 4.0, rounds: int = 6):
    """(SUBSPACES, 16, d / SUBSPACES) code words for the sample ``x``."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = _padded(x)
    n, wide = len(x), x.shape[1] // SUBSPACES
    parts = x.reshape(n, SUBSPACES, wide)
    books = np.empty((SUBSPACES, 16, wide))
    for m in range(SUBSPACES):
        books[m] = parts[rng.choice(n, 16, replace=n < 16), m] + rng.normal(0, 1e-6, (16, wide))
        for _ in range(8):
            near = ((parts[:, m, None, :] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(16):
                if (near == k).any():
                    books[m, k] = parts[near == k, m].mean(axis=0)
    norm = np.linalg.norm(x, axis=1)
    unit = (x / norm[:, None]).reshape(parts.shape)
    for _ in range(rounds):
        codes = _assign(x, books, ratio)
        along = np.stack([np.einsum("nw,nw->n", unit[:, m], books[m][codes[:, m]]) for m in range(SUBSPACES)], axis=1)
        for m in range(SUBSPACES):
            rest = norm - along.sum(axis=1) + along[:, m]
            for k in range(16):
                mine = codes[:, m] == k
                if mine.any():
                    u = unit[mine, m]
                    gram = mine.sum() * np.eye(wide) + (ratio - 1) * u.T @ u
                    books[m, k] = np.linalg.solve(gram, parts[mine, m].sum(axis=0) + (ratio - 1) * u.T @ rest[mine])
            along[:, m] = np.einsum("nw,nw->n", unit[:, m], books[m][codes[:, m]])
    return books


def fit_cells(x, cells: int, rounds: int = 8):
    """Centres of coarse cells: k-means over the sample ``x``."""
    import numpy as np

    rng = np.random.default_rng(17)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_cells(x, centres, 1)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _nearest_cells(x, centres, n: int):
    """Numbers of the ``n`` nearest centres of each row, nearest first."""
    import numpy as np

    out = np.empty((len(x), n), np.int64)
    for at in range(0, len(x), 4096):
        d = (centres**2).sum(axis=1)[None] - 2 * x[at : at + 4096] @ centres.T
        out[at : at + 4096] = np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None]
    return out


def scan_noise(x, books, ratio: float) -> float:
    """Standard deviation of scanned minus true inner products between rows of the sample."""
    import numpy as np

    x = _padded(x)
    codes = _assign(x, books, ratio)
    coded = books[np.arange(SUBSPACES)[None], codes].reshape(x.shape)
    return float(((x - coded) @ x[:256].T).std())


def encode(rows: DataFrame, books, centres, ratio: float = 4.0, scale: float = 1.0) -> DataFrame:
    """``rows`` with ``code``, SUBSPACES codes of 4 bits, two in a byte, and with ``cell``.

    Books and centres are in units of ``scale``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            parts = []
            x = _matrix(batch.column(1)) / scale
            for at in range(0, len(x), 4096):
                codes = _assign(_padded(x[at : at + 4096]), books, ratio).astype(np.uint8)
                parts += [c.tobytes() for c in codes[:, ::2] | codes[:, 1::2] << 4]
            cell = _nearest_cells(x, centres, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.binary()), pa.array(cell)], names)

    names = ["id", "v", "copies", "code", "cell"]
    return rows.mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, copies long, code binary, cell int")


def _merge(best_d, best_i, best_c, d, i, c, k: int):
    """The ``k`` nearest of two lists, ties to the smaller id, a line of several copies filling several places."""
    import numpy as np

    d, i, c = np.concatenate([best_d, d]), np.concatenate([best_i, i]), np.concatenate([best_c, c])
    order = np.lexsort((i, d))
    before = np.cumsum(c[order]) - c[order]
    order = order[before < k]
    return d[order], i[order], c[order]


def _unit(rows: pa.Table, asked: pa.Table, books, k: int, depth: int, slack: float, scale: float) -> pa.Table:
    """(q, vec_id, copies, score): the nearest rows of one unit for every query that probes its cell."""
    import numpy as np

    vec, copies = (np.asarray(rows.column(c)) for c in ("id", "copies"))
    x = _padded(_matrix(rows.column("v").combine_chunks()))
    own = np.asarray(asked.column("id"))
    q = _padded(_matrix(asked.column("v").combine_chunks()))
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)
    half = (((x / scale) ** 2).sum(axis=1) / 2).astype(np.float32)
    tables = np.einsum("qmw,mkw->qmk", (q / scale).reshape(len(q), SUBSPACES, -1), books)
    low, high = np.arange(256) & 15, np.arange(256) >> 4
    tables = (tables[:, ::2][:, :, low] + tables[:, 1::2][:, :, high]).astype(np.float32)
    out = []
    keep, kth = min(depth, len(x)), min(k + 1, len(x))
    for a in range(0, len(q), 64):
        b = min(len(q), a + 64)
        near = np.broadcast_to(half, (b - a, len(x))).copy()
        for m in range(codes.shape[1]):
            near -= tables[a:b, m][:, codes[:, m]]
        front = np.partition(near, sorted({kth - 1, keep - 1}), axis=1)
        # all that the scan can't tell from the k-th best, and ``depth`` rows at least
        cutoff = np.maximum(front[:, keep - 1], front[:, kth - 1] + slack)
        for r in range(b - a):
            pick = np.flatnonzero(near[r] <= cutoff[r])
            exact = np.sqrt(((x[pick] - q[a + r]) ** 2).sum(axis=1))
            # the query's own row is one of the copies of its line
            left = copies[pick] - ((vec[pick] == own[a + r]) & (exact == 0))
            pick, exact, left = pick[left > 0], exact[left > 0], left[left > 0]
            none = np.empty(0)
            d, i, c = _merge(none, none.astype(np.int64), none.astype(np.int64), exact, vec[pick], left, k)
            out.append((np.full(len(d), asked.column("q")[a + r].as_py()), i, c, d))
    cols = [np.concatenate(p) for p in zip(*out)]
    return pa.table({"q": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "copies": cols[2].astype(np.int64), "score": cols[3]})


def _true_cells(coded: DataFrame, ids, queries, k: int, scale: float) -> DataFrame:
    """(q, cell, score, vec_id): each task's ``k`` nearest rows of a bounded set of queries, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)) for _ in ids]
        for batch in batches:
            x, vec, cell = _matrix(batch.column(1)) / scale, np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for at in range(0, len(x), 8192):
                part = slice(at, at + 8192)
                d = (x[part] ** 2).sum(axis=1)[None] - 2 * queries @ x[part].T + (queries**2).sum(axis=1)[:, None]
                d[np.asarray(ids)[:, None] == vec[part][None]] = np.inf
                for r in range(len(ids)):
                    near = np.argpartition(d[r], min(k, d.shape[1]) - 1)[:k]
                    m = [np.concatenate(p) for p in zip(held[r], (d[r][near], vec[part][near], cell[part][near]))]
                    first = np.argsort(m[0], kind="stable")[:k]
                    held[r] = tuple(p[first] for p in m)
        q = np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])
        d, vec, cell = (np.concatenate([h[c] for h in held]) for c in range(3))
        fine = np.isfinite(d)
        cols = [pa.array(p[fine]) for p in (q, cell, d, vec)]
        yield pa.RecordBatch.from_arrays(cols, ["q", "cell", "score", "vec_id"])

    found = coded.select("id", "v", "cell").mapInArrow(run, "q long, cell int, score double, vec_id long")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def probes_needed(coded: DataFrame, asked: DataFrame, centres, k: int, reach: float, scale: float = 1.0, sample: int = 128) -> int:
    """The fewest nearest cells that hold ``reach`` of the true neighbours of ``sample`` queries, measured on all rows."""
    import numpy as np

    drawn = asked.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow()  # a bounded sample
    ids, queries = drawn.column(0).to_pylist(), _matrix(drawn.column(1).combine_chunks()) / scale
    place = np.argsort(_nearest_cells(queries, centres, len(centres)), axis=1)
    at = [place[r["q"], r["cell"]] for r in _true_cells(coded, ids, queries, k, scale).select("q", "cell").collect()]
    return int(np.sort(at)[min(len(at), int(np.ceil(reach * len(at)))) - 1]) + 1 if at else 1


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 16_384,
    depth: int = 192,
    ratio: float = 4.0,
    reach: float = 0.97,
    cells: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for the rows where ``is_query``.

    ``is_query`` is a condition on ``id`` (a long).  Of every unit of a probed cell the ``depth`` best scanned
    rows are ranked exactly, with all ties and all that come within four standard deviations of the
    scan's error of the ``k``-th, so dense groups are not cut off; ties go to the smaller id; with
    fewer than ``k`` candidates in the probed cells those are returned, and all cells are probed if the table
    has at most ``UNIT_ROWS`` rows.  Candidates are all rows but the query's own, rows that repeat an id
    included; a query whose id and vector are repeated is answered once.  Unusable vectors, null ids and
    lengths other than the most common take no part.  An empty table gives an empty result.
    """
    rows = usable_rows(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow()  # a bounded sample
    if drawn.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # codes and cells in units of the largest component, so that no square leaves the range of a float
    scale = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    taught = _matrix(drawn.column(0).combine_chunks()) / scale
    books = fit_codebooks(taught, ratio)
    slack = 4 * scan_noise(taught, books, ratio)
    total = rows.count()
    wanted = cells or (1 if total <= UNIT_ROWS else min(1024, len(taught) // 16, round(total**0.5 / 2)))
    centres = fit_cells(taught, wanted)
    coded = cut(encode(rows, books, centres, ratio, scale), "ann-codes")
    asked = coded.where(is_query).select("id", "v")
    sizes = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}  # a row a cell
    filled = [sizes.get(c, 0) for c in range(len(centres))]
    probes = probes_needed(coded, asked, centres, k, reach, scale) if len(centres) > 1 else 1

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            cell = _nearest_cells(_matrix(batch.column(1)) / scale, centres, len(centres))
            # the measured number, and more where these hold fewer than k others
            enough = (np.cumsum(np.asarray(filled)[cell], axis=1) <= k).sum(axis=1) + 1
            lists = [row[: max(probes, n)].astype(np.int32) for row, n in zip(cell, enough)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "cells"])

    kind = asked.schema["v"].dataType.simpleString()
    probing = asked.mapInArrow(near, f"id long, v {kind}, cells array<int>").withColumn("q", F.xxhash64("id", "v"))
    probing = cut(probing.select("q", "id", "v", F.explode("cells").alias("cell")), "ann-probes")
    held = coded.groupBy("cell").agg(F.ceil(F.count("*") / UNIT_ROWS).cast("int").alias("row_units"))
    aims = probing.groupBy("cell").agg(F.ceil(F.count("*") / UNIT_QUERIES).cast("int").alias("query_units"))
    plan = cut(held.join(aims, "cell"), "ann-plan")  # a row a cell
    i, j = F.pmod(F.xxhash64("id", "v"), F.col("row_units")), F.pmod(F.xxhash64("id", "v"), F.col("query_units"))
    left = coded.join(plan, "cell").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_units") - 1)))
    right = probing.join(plan, "cell").withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("row_units") - 1)))
    left = left.select("cell", F.col("i").cast("int"), F.col("j").cast("int"), "id", "v", "copies", "code")
    right = right.select("cell", F.col("i").cast("int"), F.col("j").cast("int"), "q", "id", "v")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("q", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("score", pa.float64()))})
        return _unit(rows, asked, books, k, depth, slack, scale)

    keys = ["cell", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, vec_id long, copies long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    ranked = found.withColumn("before", F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # rows that are alike fill a place each
    last = F.least(F.lit(k), F.col("before") + F.col("copies"))
    ranked = ranked.where(F.col("before") < k).withColumn("rank", F.explode(F.sequence(F.col("before") + 1, last)))
    names = probing.select("q", F.col("id").alias("query_id")).distinct()
    return ranked.join(names, "q").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
