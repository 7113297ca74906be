"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most ``2t + 1`` of 64 bits differ in at most ``t`` bits of one of
their two 32-bit halves (pigeonhole), so each half is handled with threshold ``t``; for the
contract's 2 bits, t = 1.  Anchors are the code words of the perfect [31, 26] Hamming code over 31 bits
of a half: covering radius 1, 2**26 anchors.  A fingerprint's home is the one anchor within
the radius; it is replicated to every anchor within radius + t.  Two fingerprints within t in
that half therefore always meet at the home of either, where all 64 bits are compared.

Only distinct fingerprints are compared, so copies cost nothing.  An anchor that is home to
more than ``crowded`` fingerprints is not compared pairwise: its members go to the 65 points
within one bit of them, and everything that shares such a midpoint is within two bits of each
other, hence linked through the smallest member.  That is exact and linear in the group.

The pipeline's stage has a rule of its own, Jaccard similarity of five-word shingles.  Bits of pairs at
0.8 differ with probability 0.15 each, so two of them are within one bit in a 31-bit block with
probability 0.04: covering codes would need 170 blocks of 16 anchors a document to miss one pair in a
thousand.  The stage's anchors are bands of shingle minima instead, and every candidate's sets are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .components import connected_components
from .shared import cut, drop, fresh, tidy

BITS, CHECKS = 31, 5
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at a time, so that a giant document never is one list.
SLICE = 400_000


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of a whole text's word shingles, repeats included.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are space-joined and hashed with
    XXH64, seed 42.  Fewer words than a shingle: the whole sequence is one; no words or a null
    text: zero.  Nulls and repeats of the id pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fingerprints_of(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _word_runs(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``SLICE`` bytes."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            blank = BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end].split()
        at = end


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[list[int]]:
    """XXH64 (seed 42) of the text's shingles in order, repeats included, slice by slice."""
    from xxhash import xxh64_intdigest

    tail: list[bytes] = []
    some = False
    for row in _word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        row = tail + row
        if len(row) >= shingle:
            some = True
            yield [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(row[i:] for i in range(shingle)))]
        tail = row[len(row) - shingle + 1 :] if len(row) >= shingle else row
    if tail and not some:
        yield [xxh64_intdigest(b" ".join(tail), 42)]


def _class_of(text: str | None) -> int:
    """A signed 64-bit hash of the text's word sequence."""
    from xxhash import xxh64

    h = xxh64(seed=7)
    for row in _word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        if row:
            h.update(b" ".join(row) + b" ")
    n = h.intdigest()
    return n - (1 << 64) if n >> 63 else n


def _fingerprints_of(texts: pa.Array, shingle: int) -> pa.Array:
    import numpy as np

    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    spans: list[tuple[int, int]] = []

    def flush() -> None:
        if hashes:
            raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            np.add.at(ones, [k for k, _ in spans], np.add.reduceat(bits, [at for _, at in spans], axis=0, dtype=np.int64))
            hashes.clear()
            spans.clear()

    for k, text in enumerate(texts):
        for part in _shingle_hashes(text.as_py(), shingle):
            spans.append((k, len(hashes)))
            hashes.extend(part)
            total[k] += len(part)
            if len(hashes) > 60_000:
                flush()
    flush()
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    return pa.array(packed.view("<i8").ravel())


def _half(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * block).bitwiseAND(F.lit((1 << BITS) - 1))


def _syndrome(half: Column) -> Column:
    """Bit j of a word has the check column j + 1, as in the usual Hamming code."""
    masks = [sum(1 << j for j in range(BITS) if (j + 1) >> p & 1) for p in range(CHECKS)]
    parts = [F.pmod(F.bit_count(half.bitwiseAND(F.lit(m))), F.lit(2)) * (1 << p) for p, m in enumerate(masks)]
    return reduce(lambda x, y: x + y, parts)


def _patterns(radius: int) -> list[list[int]]:
    """For each syndrome, the error patterns of at most ``radius`` bits that lead to a code word."""
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for n in range(radius + 1):
        for at in combinations(range(BITS), n):
            found[reduce(lambda s, j: s ^ (j + 1), at, 0)].append(sum(1 << j for j in at))
    return found


def _at_anchors(fps: DataFrame, radius: int) -> DataFrame:
    """(block, anchor, fp) for every anchor within ``radius`` of each half."""
    patterns = F.lit(_patterns(radius)).cast("array<array<bigint>>")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("block")).withColumn(
        "half", F.when(F.col("block") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))
    )
    near = halves.select("fp", "block", "half", F.explode(F.get(patterns, _syndrome(F.col("half")))).alias("e"))
    return near.select("block", F.col("half").bitwiseXOR(F.col("e")).alias("anchor"), "fp")


def links(fps: DataFrame, crowded: int = 32) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints in ``fp`` linked at 2 or fewer bits.

    Spark sizes a table after ``explode`` as if it had the rows of before: the joins are merges, so that no such table is
    broadcast (a fingerprint has up to 32 places at anchors and 65 midpoints).
    """
    home = (
        _at_anchors(fps, 1)
        .groupBy("block", "anchor")
        .agg(F.count("*").alias("n"))
    )
    few = home.where(F.col("n") <= crowded)
    many = home.where(F.col("n") > crowded).select("block", "anchor")
    homes = (
        _at_anchors(fps, 1)
        .join(few.hint("merge"), ["block", "anchor"], "left_semi")
        .groupBy("block", "anchor")
        .agg(F.collect_list("fp").alias("homes"))
    )
    guests = _at_anchors(fps, 2)
    close = guests.hint("merge").join(homes, ["block", "anchor"]).select(
        F.col("fp").alias("a"),
        F.explode(
            F.filter("homes", lambda h: (F.bit_count(h.bitwiseXOR(F.col("fp"))) <= 2) & (h != F.col("fp")))
        ).alias("b"),
    )
    dense = guests.join(many.hint("merge"), ["block", "anchor"], "left_semi").select("fp").distinct()
    flips = F.lit([0] + [1 << j for j in range(63)] + [-(1 << 63)]).cast("array<bigint>")
    points = dense.select("fp", F.explode(flips).alias("e")).select("fp", F.col("fp").bitwiseXOR(F.col("e")).alias("z"))
    stars = points.groupBy("z").agg(F.min("fp").alias("m"))
    through = points.hint("merge").join(stars, "z").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return close.union(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``.

    Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest id reachable
    over links, the row's own included.  A component of nothing but null ids has a null
    component_id.  Empty and null texts have fingerprint zero and link like any other.
    """
    marked = cut(fingerprints(docs, id_col, text_col), "simhash")
    return marked.join(_components_of(marked), "fp").select("doc_id", "fp", "component_id")


def _components_of(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints in (doc_id, fp)."""
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    found = connected_components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


#: The stage's own rule: shingles of five words, linked from this Jaccard similarity on.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Anchors of the stage: a pair at similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8.
BANDS, ROWS = 20, 5


def _sketches(texts: pa.Array, shingle: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(class, anchors, set) of each text: a hash of its word sequence, ``BANDS`` hashes of ``ROWS`` minima over its
    shingles, and the sorted 32-bit hashes of its distinct shingles."""
    import numpy as np

    rng = np.random.default_rng(64)
    a, b = (rng.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    a |= np.uint64(1)
    mix = rng.integers(0, 1 << 64, size=ROWS, dtype=np.uint64) | np.uint64(1)
    classes, anchors, sets = [], [], []
    for text in (t.as_py() for t in texts):
        classes.append(_class_of(text))
        parts = [np.unique(np.array(p, np.uint64)) for p in _shingle_hashes(text, shingle)]
        hs = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        sets.append(np.unique((hs >> np.uint64(32)).astype(np.uint32)).view(np.int32))
        if not len(hs):
            anchors.append(np.empty(0, np.int64))
            continue
        least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max)
        for at in range(0, len(hs), 4096):
            least = np.minimum(least, (hs[None, at : at + 4096] * a + b).min(axis=1, keepdims=True))
        least ^= least >> np.uint64(29)
        joint = (least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64)
        anchors.append((joint ^ (joint >> np.uint64(31))).view(np.int64))
    return (
        pa.array(classes, pa.int64()),
        pa.array(anchors, pa.list_(pa.int64())),
        pa.array(sets, pa.list_(pa.int32())),
    )


#: Classes in a bin of the exact comparison of a crowded anchor, and shingles in it at most (one class aside).
BIN, BIN_SHINGLES = 512, 1_000_000


def similar(sketched: DataFrame, similarity: float = STAGE_SIMILARITY, crowded: int = 12) -> DataFrame:
    """Links (a, b) that connect the classes in (cls, anchors, grams) whose sets have at least this Jaccard similarity.

    Classes that share an anchor are candidates, checked on their whole sets: all pairs of an anchor with at
    most ``crowded`` classes.  In larger ones every class is checked against the two smallest first, which
    leaves most groups of near copies in one component; where an anchor still holds several components
    its pairs across components are all checked, in bins, so no connection of an anchor is lost and a
    large group of copies costs in proportion to its members.
    """
    at = sketched.select("cls", F.posexplode("anchors").alias("band", "anchor"))
    sizes = at.groupBy("band", "anchor").agg(F.count("*").alias("n"), F.min("cls").alias("m")).where("n > 1")
    few = at.join(sizes.where(F.col("n") <= crowded).select("band", "anchor"), ["band", "anchor"])
    few = few.groupBy("band", "anchor").agg(F.collect_list("cls").alias("all")).select("all", F.explode("all").alias("a"))
    pairs = few.select("a", F.explode(F.filter("all", lambda c: c > F.col("a"))).alias("b"))
    many = at.join(sizes.where(F.col("n") > crowded).select("band", "anchor", "m"), ["band", "anchor"])
    next_ = many.where("cls > m").groupBy("band", "anchor").agg(F.min("cls").alias("m2"))
    star = many.where("cls > m").select(F.col("m").alias("a"), F.col("cls").alias("b"))
    second = many.join(next_, ["band", "anchor"]).where("cls > m2").select(F.col("m2").alias("a"), F.col("cls").alias("b"))
    pairs = pairs.union(star).union(second).distinct()
    left = sketched.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    right = sketched.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    found = both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")
    found = cut(found, "near-links")
    roots = cut(connected_components(found).withColumnRenamed("node", "cls"), "near-roots")
    # anchors of equal members count once, so a group of copies is not looked at in every band
    member = many.select("band", "anchor", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_ = member.groupBy("band", "anchor").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s")
    ).where("lo < hi")
    open_ = cut(open_.groupBy("n", "s").agg(F.min(F.struct("band", "anchor")).alias("k")).select("k.band", "k.anchor"), "near-open")
    if open_.isEmpty():
        return found
    member = member.join(open_, ["band", "anchor"]).join(sketched.select("cls", F.size("grams").alias("size")), "cls")
    return found.union(_across(member, sketched.select("cls", "grams"), similarity))


def _across(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the components inside an anchor, one at least for every two that are linked.

    ``member`` is (band, anchor, cls, root, size).  Sizes of linked sets differ by a factor of
    ``similarity`` at most, so classes are dealt by the logarithm of their size; a component over a bin
    has bins of its own, smaller ones share bins, and two bins meet unless they hold one and the same component.
    """
    from math import log

    place = ["band", "anchor", "step"]
    member = member.withColumn("step", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(log(1 / similarity)) + 1e-9).cast("int"))
    most = F.greatest(F.lit(1), F.least(F.lit(BIN), F.floor(F.lit(BIN_SHINGLES) / F.max(F.greatest("size", F.lit(1))))))
    per_root = member.groupBy(*place, "root").agg(F.count("*").alias("n"), most.alias("most"))
    per_root = per_root.withColumn("own", F.when(F.col("n") >= F.col("most"), F.col("root")))
    bins = per_root.groupBy(*place, "own").agg(F.ceil(F.sum("n") / F.min("most")).cast("int").alias("bins"))
    bins = bins.select(*[F.col(c).alias("b_" + c) for c in place], F.col("own").alias("b_own"), "bins")
    per_root = cut(per_root.select(*place, "root", "own"), "near-sizes")
    dealt = member.join(per_root, [*place, "root"])
    dealt = dealt.join(bins, reduce(Column.__and__, [F.col(c) == F.col("b_" + c) for c in place]) & F.col("own").eqNullSafe(F.col("b_own")))
    nth = F.pmod(F.xxhash64("cls"), F.col("bins")).cast("int")
    end = F.struct("step", F.col("own").isNull().alias("mixed"), F.coalesce("own", F.lit(0)).alias("own"), nth.alias("nth"))
    dealt = cut(dealt.select("band", "anchor", "cls", "root", end.alias("e")), "near-bins")
    kinds = dealt.select("band", "anchor", "e").distinct()
    meet = kinds.withColumnRenamed("e", "i").join(kinds.withColumnRenamed("e", "j"), ["band", "anchor"])
    alike = ~F.col("i.mixed") & ~F.col("j.mixed") & (F.col("i.own") == F.col("j.own"))  # one and the same component
    meet = cut(meet.where((F.col("i") <= F.col("j")) & (F.abs(F.col("i.step") - F.col("j.step")) <= 1) & ~alike), "near-meets")
    ends = meet.select("band", "anchor", "i", "j", F.col("i").alias("e")).union(meet.where("i <> j").select("band", "anchor", "i", "j", "j"))
    rows = dealt.join(ends, ["band", "anchor", "e"]).join(sets, "cls")
    unit = F.xxhash64("band", "anchor", "i", "j")
    rows = rows.select(unit.alias("unit"), (F.col("e") == F.col("i")).alias("left"), (F.col("i") == F.col("j")).alias("same"), "cls", "root", "grams")

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        cls, root = (np.asarray(table.column(k)) for k in ("cls", "root"))
        grams = table.column("grams").combine_chunks()
        size = np.diff(np.asarray(grams.offsets))
        left, same = np.asarray(table.column("left")), np.asarray(table.column("same"))
        ones = np.flatnonzero(left)
        twos = ones if same.all() else np.flatnonzero(~left)
        parts = [np.asarray(grams[int(k)].values) for k in twos]
        held = np.concatenate(parts) if parts else np.empty(0, np.int32)
        owner = np.repeat(np.arange(len(twos)), [len(p) for p in parts])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        seen: set[tuple[int, int]] = set()
        out = []
        for k in ones:
            mine = np.asarray(grams[int(k)].values)
            lo, hi = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
            hits = [owner[p:q] for p, q in zip(lo, hi) if q > p]
            common = np.bincount(np.concatenate(hits), minlength=len(twos)) if hits else np.zeros(len(twos), int)
            for t in np.flatnonzero((common >= similarity * (size[k] + size[twos] - common)) & (root[twos] != root[k])):
                both = tuple(sorted((int(root[k]), int(root[twos[t]]))))
                if both not in seen:
                    seen.add(both)
                    out.append((int(cls[k]), int(cls[twos[t]])))
        return pa.table({n: pa.array([o[c] for o in out], pa.int64()) for c, n in enumerate("ab")})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id (null last).

    Texts link if they have the same words or if their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more.  Rows that repeat an id and a text count as copies, so one of
    them stays.  All columns are returned unchanged, whatever their names.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_sketches(batch.column(1), STAGE_SHINGLE)], ["doc_id", "cls", "anchors", "grams"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    shown = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, cls long, anchors array<long>, grams array<int>")
    marked = cut(shown, "sketches")
    sketched = cut(marked.groupBy("cls").agg(F.first("anchors").alias("anchors"), F.first("grams").alias("grams")), "classes")
    roots = connected_components(similar(sketched)).withColumnRenamed("node", "cls")
    ids = marked.select("doc_id", "cls").distinct().join(roots, "cls", "left")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("cls"))
    best = ids.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min(rank).alias("best"))
    cls, key, k, b = fresh(names, "cls", "key", "best_key", "best_cls")
    best = cut(best.select(_key(F.col("best.doc_id")).alias(k), F.col("best.cls").alias(b)), "near-kept")
    drop(marked)
    drop(sketched)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_class_of(t.as_py()) for t in batch.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*names, cls])
        tidy()

    schema = T.StructType([*docs.schema.fields, T.StructField(cls, T.LongType())])
    # one exchange of the texts: the semi join and the removal of repeated rows share its partitioning
    own = docs.mapInArrow(mark, schema).withColumn(key, _key(F.col(id_col)))
    own = own.join(best, (F.col(key) == F.col(k)) & (F.col(cls) == F.col(b)), "left_semi")
    return own.dropDuplicates([key, cls]).select(*names)


def _key(id_column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("i"), id_column.cast("string")), F.lit("none"))
