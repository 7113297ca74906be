"""Token alignment of two tokenizers by galloping intersection of their end offsets.

For a text both tokenizers give lists of byte offsets at which tokens end.  The shorter list drives:
each of its ends is sought in the longer one by steps that double from the last place found, then by a
binary search inside the last step.  Common ends cut both token lists into groups; the difference of two
neighbouring common ranks is the number of tokens of a group, on either side.

Neither tokenizer joins anything across a blank that has no blank before it and no white space behind it (the
first one's pattern starts a match there whatever precedes, the second one has no piece with a blank
behind another character, which is checked), so such a place ends a token of both.  What lies between two
such places is worked out once a task; the texts encoded and the lists that gallop are runs of new units, set
one behind the other.

Corpus counts of id pairs go through blocks.  A task turns a bounded amount of text into one block: a
dictionary of the block's distinct pairs with the number of its documents that hold them, and for each
document positions in that dictionary.  Only dictionaries are shuffled: summed by pair, compared with
the best pair of their first id (one row a token of the first vocabulary), and sent back to their blocks.
No table of pairs is broadcast, and no row a document and pair leaves its block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, slices
from .shared import cut, drop, tidy

#: Bytes of text in a block, units a task remembers, and characters from which a unit is not remembered.
BLOCK, CACHED_UNITS, LONG = 6_000_000, 250_000, 256
#: An id pair is one number: the first id times this, plus the second.
SECOND = 1 << 31
#: Blanks at which a text is not cut, besides one at its start.
KEPT_BLANK = re.compile(r" (?=\s|\Z)")
#: New units encoded as one text, and aligned at once.
RUN, BATCH = 500, 20_000


def units(text: str) -> list[str]:
    """The text cut at, and without, each blank that has no blank before it and no white space behind it.

    Every unit, the first included, is read with a blank before it.
    """
    parts = text.split(" ")
    if not text.startswith(" ") and not KEPT_BLANK.search(text):
        return parts
    out, run = [], [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if before and part and not part[0].isspace():
            out.append(" ".join(run))
            run = [part]
        else:
            run.append(part)
    out.append(" ".join(run))
    return out


def galloping(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """Ranks in ``short`` and in ``long`` of the numbers that two ascending lists share."""
    mine, other, at, size = [], [], 0, len(long)
    if not size:
        return mine, other
    found = long[0]
    for rank, end in enumerate(short):
        if found < end:
            low, step = at + 1, 1
            at += 1
            while at < size and long[at] < end:  # the bound doubles its distance from the last place found
                low = at + 1
                at += step
                step *= 2
            if low < at:
                at = bisect_left(long, end, low, min(at + 1, size))
            if at == size:
                break
            found = long[at]
        if found == end:
            mine.append(rank)
            other.append(at)
    return mine, other


def common_ranks(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Ranks in both lists of the ends they share; the shorter one drives."""
    if len(ends_a) <= len(ends_b):
        return galloping(ends_a, ends_b)
    b, a = galloping(ends_b, ends_a)
    return a, b


def default_tokenizers() -> tuple[str, bytes]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


class Aligner:
    """Both tokenizers, and what is known of the units met so far."""

    def __init__(self, first: str, second: bytes, cached: int = CACHED_UNITS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.cached = cached
        self.a = Tokenizer.from_str(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        number = {c: b for b, c in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(number[c] for c in token)
        self.bytes_b = [self._piece(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        import numpy as np

        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shown_a, self.shown_b = ([str(k) for k in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        if any(b" " in t.lstrip(b" ") for t in self.bytes_b):
            raise ValueError("texts are cut at blanks, which needs pieces without a blank behind another character")
        self.forget()

    @staticmethod
    def _piece(piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        """Start over with no unit known."""
        import numpy as np

        self.place: dict[str, int] = {}
        self.shown: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links; -1 where bytes differ
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, wanted: set[str]) -> None:
        """Align units, each read with a blank before it."""
        import numpy as np

        new, odd = [], []
        for u in wanted:
            if u not in self.place:  # the first and the last unit of a text may have white space at its own ends
                (new if u and u[-1] != " " and not u[0].isspace() else odd).append(u)
        found = [self._aligned(some[at : at + BATCH], run) for some, run in ((new, RUN), (odd, 1)) for at in range(0, len(some), BATCH)]
        new += odd
        if not new:
            return
        self.place.update(zip(new, range(len(self.shown), len(self.shown) + len(new))))
        self.shown += [x for shown, *_ in found for x in shown]
        self.numbers = np.concatenate([self.numbers, *[f[1] for f in found]])
        sizes = np.concatenate([f[2] for f in found])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.pairs = np.concatenate([self.pairs, *[f[3] for f in found]])
        self.times = np.concatenate([self.times, *[f[4] for f in found]])

    def _aligned(self, new: list[str], run: int) -> tuple:
        """``run`` units are encoded as one text.  Of each unit its groups as text, its four numbers and its number of distinct pairs; all pairs and their times."""
        import numpy as np

        runs = [" ".join(new[at : at + run]) for at in range(0, len(new), run)]
        flat_a = np.concatenate([np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)])
        ids_b = self.b.encode(runs, num_threads=1)
        flat_b = np.concatenate([np.array(ids, np.int64) for ids in ids_b])
        list_a, list_b = flat_a.tolist(), flat_b.tolist()
        raw = "".join([" " + r for r in runs]).encode()
        if not b"".join([self.bytes_a[k] for k in list_a]) == raw == b"".join([self.bytes_b[k] for k in list_b]):
            return self._without_broken(new, run)
        ends = np.cumsum(np.fromiter([len(u.encode()) + 1 for u in new], np.int64, len(new)))  # where units end
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        n_a, n_b = (np.diff(np.searchsorted(e, ends, side="right"), prepend=0) for e in (ends_a, ends_b))
        stop_a, stop_b = (np.array(r, np.int64) + 1 for r in common_ranks(ends_a.tolist(), ends_b.tolist()))
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        owner = np.searchsorted(ends, ends_a[stop_a - 1])  # the unit of a group
        n_groups = np.bincount(owner, minlength=len(new))
        links = size_a * size_b
        n_links = np.bincount(owner, weights=links, minlength=len(new)).astype(np.int64)
        shown_a, shown_b = [self.shown_a[k] for k in list_a], [self.shown_b[k] for k in list_b]
        texts, a0, b0 = [], 0, 0
        for a1, b1 in zip(stop_a.tolist(), stop_b.tolist()):
            texts.append(f"{shown_a[a0]}|{shown_b[b0]}" if a1 - a0 == 1 == b1 - b0 else f"{','.join(shown_a[a0:a1])}|{','.join(shown_b[b0:b1])}")
            a0, b0 = a1, b1
        upto = np.cumsum(n_groups).tolist()
        shown = [";".join(texts[g0:g1]) for g0, g1 in zip([0, *upto], upto)]
        # every link of every group, then its distinct pairs a unit
        inside = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        wide = np.repeat(size_b, links)
        pair = flat_a[np.repeat(stop_a - size_a, links) + inside // wide] * SECOND + flat_b[np.repeat(stop_b - size_b, links) + inside % wide]
        unit = np.repeat(owner, links)
        order = np.lexsort((pair, unit))
        pair, unit = pair[order], unit[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])]))
        times = np.diff(np.append(first, len(pair)))
        sizes = np.bincount(unit[first], minlength=len(new))
        return shown, np.stack([n_a, n_b, n_groups, n_links], axis=1), sizes, pair[first], times

    def _without_broken(self, new: list[str], run: int) -> tuple:
        """As above where some unit is not given back: each is tried alone, the good ones are aligned together."""
        import numpy as np

        def kept(unit: str) -> bool:
            of_a, of_b = self.a.encode(" " + unit, add_special_tokens=False).ids, self.b.encode(unit)
            return b"".join([self.bytes_a[k] for k in of_a]) == b" " + unit.encode() == b"".join([self.bytes_b[k] for k in of_b])

        good = [kept(u) for u in new]
        shown, numbers, sizes = np.full(len(new), "", dtype=object), np.full((len(new), 4), -1, np.int64), np.zeros(len(new), np.int64)
        if not any(good):
            return shown.tolist(), numbers, sizes, sizes[:0], sizes[:0]
        at = np.flatnonzero(good)
        shown[at], numbers[at], sizes[at], pairs, times = self._aligned([new[k] for k in at], run)
        return shown.tolist(), numbers, sizes, pairs, times

    def block(self, texts: list[str]) -> tuple[list[tuple], list, tuple]:
        """Per text (n_a, n_b, n_groups, n_links, digest); per text (positions, times); the block's (pairs, documents)."""
        from hashlib import sha256

        import numpy as np

        if len(self.place) > self.cached or any(len(u) > LONG for u in self.place):
            self.forget()
        rows = [units(t) if t else [] for t in texts]
        self.learn({u for row in rows for u in row})
        n = np.array([len(r) for r in rows], np.int64)
        each = np.fromiter(map(self.place.__getitem__, chain.from_iterable(rows)), np.int64, n.sum())
        shown = list(map(self.shown.__getitem__, each.tolist()))
        stops = np.cumsum(n)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[each], axis=0)])
        sums = sums[stops] - sums[stops - n]
        broken = np.concatenate([[0], np.cumsum(self.numbers[each, 0] < 0)])
        good = (n > 0) & (broken[stops] == broken[stops - n])
        told = [
            (*t, sha256(";".join(shown[a:b]).encode()).hexdigest()) if g else (0, 0, 0, 0, "")
            for g, a, b, t in zip(good.tolist(), (stops - n).tolist(), stops.tolist(), sums.tolist())
        ]
        # (text, unit) with its repeats, then each unit's pairs, then (text, pair) with its repeats
        n_units = len(self.shown) or 1
        key = (np.repeat(np.arange(len(texts)), n) * n_units + each)[np.repeat(good, n)]
        key, repeats = np.unique(key, return_counts=True)
        unit = key % n_units
        distinct, code = np.unique(self.pairs, return_inverse=True)
        length = np.diff(self.starts)[unit] if len(unit) else unit
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.starts[unit], length)
        wide = len(distinct) or 1
        linked = np.repeat(key // n_units, length) * wide + code[inside]
        weight = self.times[inside] * np.repeat(repeats, length)
        order = np.argsort(linked)
        linked, weight = linked[order], weight[order]
        first = np.flatnonzero(np.diff(linked, prepend=-1))
        total = np.add.reduceat(weight, first) if len(first) else weight
        linked = linked[first]
        position = linked % wide
        documents = np.bincount(position, minlength=wide)
        held = np.flatnonzero(documents)  # units known from earlier blocks have pairs this one lacks
        place_of = np.zeros(wide, np.int64)
        place_of[held] = np.arange(len(held))
        bounds = np.searchsorted(linked // wide, np.arange(len(texts) + 1))
        position = place_of[position]
        lists = [(position[a:b].astype("<i4").tobytes(), total[a:b].astype("<i8").tobytes()) for a, b in zip(bounds, bounds[1:])]
        return told, lists, (distinct[held], documents[held])


def _rows(docs: DataFrame, id_col: str, text_col: str, first: str, second: bytes, block_bytes: int, cached: int) -> DataFrame:
    """A row a document, and one a block with its dictionary of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        aligner = Aligner(first, second, cached)
        tidy()
        gc.freeze()
        gc.disable()  # the memos hold no cycles
        try:
            yield from aligned(aligner, batches)
        finally:
            gc.enable()
            del aligner
            tidy()

    def aligned(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in slices(batches, 1, 2_000_000):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if size >= block_bytes:
                yield from block(aligner, number, held)
                held, size, number = [], 0, number + 1
        if held:
            yield from block(aligner, number, held)

    def block(aligner: Aligner, number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        told, lists, (distinct, documents) = aligner.block([t or "" for t in table.column(1).to_pylist()])
        n = table.num_rows
        ids = table.column(0).combine_chunks()
        cols = [pa.array([number] * n, pa.int64()), ids, *[pa.array([t[k] for t in told], pa.int64()) for k in range(4)], pa.array([t[4] for t in told], pa.string())]
        cols += [pa.array([x[k] for x in lists], pa.binary()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
        nothing = [pa.nulls(1, c.type) for c in cols[1:]]
        some = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (distinct, documents)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *nothing, *some], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, documents array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, schema)


COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, bytes] | None = None, block_bytes: int = BLOCK, cached: int = CACHED_UNITS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    A is a byte-level tokenizer JSON read with a blank before the text, B a sentencepiece model that puts one itself; special
    tokens are plain text.  Null and empty texts, and those that either tokenizer does not give back byte for byte,
    have zeros and an empty digest, and count in no pair.  Every row is a document of its own, repeated and null ids included.
    Other columns are ignored, whatever their names.  A single text is never cut: a block holds at least one.
    """
    first, second = tokenizers or default_tokenizers()
    rows = cut(_rows(docs, id_col, text_col, first, second, block_bytes, cached), "align-rows")
    words = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("position", "x"))
    words = words.select("block", "position", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    words = words.withColumn("n", F.sum("n").over(Window.partitionBy("pair"))).withColumn("a", F.floor(F.col("pair") / SECOND))
    words = cut(words, "align-pairs")
    best = words.groupBy("a").agg(F.max("n").alias("most"))  # a row a token of A's vocabulary
    counts = words.join(F.broadcast(best), "a").select("block", "position", "n", (F.col("n") == F.col("most")).alias("best"))
    documents = rows.where("pairs is null").select("block", "doc_id", *COUNTED, "groups_sha256", "at", "times")

    def finish(mine: pa.Table, dictionary: pa.Table) -> pa.Table:
        import numpy as np

        n = np.zeros(dictionary.num_rows, np.int64)
        best = np.zeros(dictionary.num_rows, bool)
        position = dictionary.column("position").to_numpy()
        n[position] = dictionary.column("n").to_numpy()
        best[position] = dictionary.column("best").combine_chunks().to_numpy(zero_copy_only=False) if len(position) else []
        n_best, count_sum = [], []
        for at, times in zip(mine.column("at"), mine.column("times")):
            at, times = np.frombuffer(at.as_py(), "<i4"), np.frombuffer(times.as_py(), "<i8")
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((n[at] * times).sum()))
        kept = [mine.column(c) for c in ("doc_id", *COUNTED)]
        return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), mine.column("groups_sha256")], out)

    out = ["doc_id", *COUNTED, "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in out[1:-1]) + ", groups_sha256 string"
    return documents.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(finish, schema)
