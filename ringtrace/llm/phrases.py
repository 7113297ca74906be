"""Phrase collocations by direct-address tiles of frequency-ranked ids.

Texts become arrays of word ids that are ranks by frequency.  The pairs of neighbouring ids fall into square
tiles of the rank plane: the crowded ones near the origin are counted in a dense table by ``numpy.bincount``,
all other pairs as a sorted coordinate list.  Frequent pairs are ranked by frequency again, and the
arrays of their ids are the input of the next level: two phrases of m words at neighbouring
places are one of m + 1, and a phrase can be frequent only if both are.

The work goes through blocks: a task turns a bounded amount of text of one language into one row with a
dictionary of its words and an array of places in it.  A block's counts are shuffled, summed by pair,
and those of frequent pairs go back to the block with the pair's new id, so no dictionary of the corpus is
ever broadcast or collected, and the most frequent word is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .shared import cut, drop, tidy

#: Bytes of text in a block; side of a tile, tiles a side that may be dense, and the share of a tile's cells its pairs must reach.
BLOCK, TILE, DENSE_TILES, DENSE_SHARE = 12_000_000, 1024, 16, 1 / 16
#: Ids are 32-bit.
MOST_IDS = (1 << 31) - 1
#: Words are ``[^\x20\x09]+`` in pieces between ``[.,;:!?\x0A-\x0D]``; A-Z are lower-cased.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")


class Places(dict):
    """Words to places in the order met; the break between pieces is place 0."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def count_pairs(i, j, tile: int = TILE):
    """Distinct (i, j) as i * 2^32 + j in ascending order, and how often each occurs, for arrays of ranks."""
    import numpy as np

    near = (i < tile * DENSE_TILES) & (j < tile * DENSE_TILES)
    loads = np.bincount((i[near] // tile) * DENSE_TILES + j[near] // tile, minlength=DENSE_TILES * DENSE_TILES)
    dense = np.flatnonzero(loads >= tile * tile * DENSE_SHARE)
    keys, counts = [], []
    if len(dense):
        at = np.where(near, (i // tile) * DENSE_TILES + j // tile, -1)
        for t in dense:
            mine = at == t
            table = np.bincount((i[mine] % tile) * tile + j[mine] % tile, minlength=tile * tile)
            cells = np.flatnonzero(table)
            keys.append((cells // tile + t // DENSE_TILES * tile) << 32 | (cells % tile + t % DENSE_TILES * tile))
            counts.append(table[cells])
        rest = ~np.isin(at, dense)
        i, j = i[rest], j[rest]
    listed, times = np.unique(i << 32 | j, return_counts=True)
    keys, counts = np.concatenate([*keys, listed]), np.concatenate([*counts, times])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """(block, lang, words, counts, ids): ids are places in ``words`` as 32-bit integers, -1 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[Places, list]] = {}

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, (places, arrays) in held.items():
                ids = np.concatenate(arrays)
                counts = np.bincount(ids, minlength=len(places))[1:]
                words = iter(places)
                next(words)
                row = [[number], [lang], [[w.decode() for w in words]], [counts], [(ids - 1).astype("<i4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, kinds)], [f.name for f in kinds])
                number += 1
            held.clear()

        for batch in slices(batches, 0, 2_000_000):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                raw = text.encode()
                size += len(raw)
                if lang not in held:
                    held[lang] = (Places(), [])
                places, arrays = held[lang]
                found = raw.translate(LOWER).replace(b"\n", b" \n ").split(b" ")
                found.append(b"\n")
                arrays.append(np.array([places[w] for w in found if w], np.int32))
            if size >= block_bytes:
                yield from full()
                size = 0
        yield from full()
        tidy()

    kinds = [pa.field("block", pa.int64()), pa.field("lang", pa.string()), pa.field("words", pa.list_(pa.string())), pa.field("counts", pa.list_(pa.int64())), pa.field("ids", pa.binary())]
    lang = F.coalesce(F.col(lang_col), F.lit("und")).alias("lang")
    return docs.select(text_col, lang).mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, ids binary")


def _frequent(counts: DataFrame, keys: list[str], least: int, keep: list[str], name: str) -> DataFrame:
    """``keep`` of the blocks' counts whose sum over all blocks, ``f``, is ``least`` or more, with ``f`` and an ``id``.

    Ids rank by frequency: keys fall into buckets by hash, are ranked inside theirs, and the ranks of the
    buckets interleave, so that low ids are the frequent ones without any task that sees all.
    """
    session = counts.sparkSession.conf
    buckets = max(256, 4 * int(session.get("spark.sql.shuffle.partitions", "200")))
    rows = counts.withColumn("f", F.sum("c").over(Window.partitionBy(*keys))).where(F.col("f") >= least)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(F.desc("f"), *keys)).cast("long")
    return cut(rows.select(*keep, "f", ((rank - 1) * buckets + F.col("bucket")).alias("id")), name, "zstd")


def _pair_counts(arrays: DataFrame) -> DataFrame:
    """(block, pair, c) of the neighbouring ids of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[k].as_py(), "<i4").astype(np.int64)
                held = (ids[:-1] >= 0) & (ids[1:] >= 0)
                pairs, counts = count_pairs(ids[:-1][held], ids[1:][held])
                block = np.full(len(pairs), batch.column(0)[k].as_py())
                for at in range(0, len(pairs), 100_000):
                    some = [x[at : at + 100_000] for x in (block, pairs, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in some], ["block", "pair", "c"])
        tidy()

    return arrays.select("block", "ids").mapInArrow(run, "block long, pair long, c long")


def _replaced(arrays: DataFrame, found: DataFrame, neighbours: bool) -> DataFrame:
    """Arrays of new ids: ``found`` has (block, key, id), keys being places or pairs of neighbours.

    Where there is none a run of places becomes a single -1, so that arrays shrink with the levels.
    """

    def run(mine: pa.Table, new: pa.Table) -> pa.Table:
        import numpy as np

        if not mine.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        ids = np.frombuffer(mine.column("ids")[0].as_py(), "<i4").astype(np.int64)
        keys, values = new.column("key").to_numpy(), new.column("id").to_numpy()
        if len(values) and values.max() > MOST_IDS:
            raise ValueError("more frequent phrases of one length than 32-bit ids")
        order = np.argsort(keys)
        keys, values = np.append(keys[order], 1 << 62), values[order]
        if neighbours:
            wanted = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | (ids[1:] & MOST_IDS), -1)
        else:
            wanted = ids
        at = np.searchsorted(keys, wanted)
        out = np.full(len(wanted), -1, np.int64)
        hit = keys[at] == wanted
        out[hit] = values[at[hit]]
        gap = out < 0
        out = out[~gap | ~np.concatenate([[True], gap[:-1]])]  # one gap parts neighbours as well as many
        del keys, values, order, wanted, at, hit, ids
        tidy()
        return pa.table({"block": mine.column("block"), "ids": pa.array([out.astype("<i4").tobytes()], pa.binary())})

    return arrays.select("block", "ids").groupBy("block").cogroup(found.select("block", "key", "id").groupBy("block")).applyInArrow(run, "block long, ids binary")


def _scored(phrases: DataFrame, longer: DataFrame | None, totals: DataFrame, inside_share: int) -> DataFrame:
    """Undominated phrases of one length with their cheapest cut; whole-number arithmetic of 38 digits."""
    if longer is not None:
        held = longer.select(F.col("i").alias("id"), "f").union(longer.select("j", "f")).groupBy("id").agg(F.max("f").alias("over"))
        phrases = phrases.join(held, "id", "left").where(F.coalesce(100 * F.col("over") < inside_share * F.col("f"), F.lit(True)))
    cuts = F.expr(
        """array_min(transform(sequence(1, size(pre) - 1), k -> named_struct('score',
             (1000 * cast(f as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(pre[k - 1] as decimal(38,0)) * cast(suf[size(pre) - k - 1] as decimal(38,0))),
             'k', k, 'l', pre[k - 1], 'r', suf[size(pre) - k - 1])))"""
    )
    return phrases.join(totals, "lang").withColumn("cut", cuts).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int | None = 2000, inside_share: int = 100,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words that occur ``least`` times or more.

    A phrase is dropped if one that holds it has ``inside_share`` percent of its occurrences or more.  ``top`` rows a language
    stay, all where it is None.  A null language is ``und``; null, empty and blank texts add nothing; every row counts, repeated
    ones included.  Phrases of equal score and frequency come in byte order.  Other columns are ignored, whatever their
    names.  A single text is never cut, so a block holds at least one.
    """
    blocks = cut(_blocks(docs, text_col, lang_col, block_bytes), "phrase-blocks", "zstd")
    totals = cut(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("key", "x")).select("block", "lang", "key", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = _frequent(words, ["lang", "word"], least, ["block", "key", "lang", "word"], "phrase-words")
    level = cut(words.groupBy("id").agg(F.any_value("lang").alias("lang"), F.any_value("word").alias("word"), F.max("f").alias("f")), "phrase-level")
    arrays = cut(_replaced(blocks, words, False), "phrase-arrays", "zstd")
    phrases = [level.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf"), "f")]
    drop(blocks)
    drop(words)
    levels = [level]
    for m in range(2, longest + 1):
        pairs = _frequent(_pair_counts(arrays), ["pair"], least, ["block", "pair"], "phrase-pairs")
        level = pairs.groupBy("id").agg(F.max("pair").alias("pair"), F.max("f").alias("f"))
        level = cut(level.select("id", F.shiftright("pair", 32).alias("i"), F.col("pair").bitwiseAND(MOST_IDS).alias("j"), "f"), "phrase-ids")
        old = arrays
        if m < longest:
            arrays = cut(_replaced(arrays, pairs.withColumnRenamed("pair", "key"), True), "phrase-arrays", "zstd")
        drop(old)
        drop(pairs)
        head = phrases[-1].select(F.col("id").alias("i"), "lang", F.col("phrase").alias("head"), F.col("pre").alias("before"))
        tail = phrases[-1].select(F.col("id").alias("j"), "last", F.col("suf").alias("behind"))
        grown = level.join(head, "i").join(tail, "j").select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last",
            F.concat("before", F.array("f")).alias("pre"), F.concat("behind", F.array("f")).alias("suf"), "f",
        )
        levels.append(level)
        phrases.append(cut(grown, "phrase-level"))
    out = None
    for k in range(1, len(phrases)):
        one = _scored(phrases[k], levels[k + 1] if k + 1 < len(levels) else None, totals, inside_share)
        out = one if out is None else out.union(one)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
rows AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM rows GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM rows),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS m) AS sizes WHERE s + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
parts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT p.lang, p.m, p.phrase, p.a, c.k, x.a AS l, y.a AS r, t.n, CAST(1000::HUGEINT * p.a * t.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM parts p, (SELECT unnest(range(1, 5)) AS k) AS c, f x, f y, totals t
  WHERE c.k < p.m AND x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.w, 1, c.k), ' ')
    AND y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.w, c.k + 1, p.m), ' ') AND t.lang = p.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase, max(a) AS over
  FROM parts, (SELECT unnest(range(2, 5)) AS k) AS c, (SELECT unnest(range(1, 5)) AS s) AS d WHERE k < m AND s + k - 1 <= m GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase WHERE h.over IS NULL OR 100 * h.over < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
