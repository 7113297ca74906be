"""Token counts with overlap resynchronisation.

Every document is cut into chunks that overlap; one that fits a chunk and its overlap is a single
chunk.  The chunks of a longer one are encoded each by itself, with offsets.  A place is a proven
stable boundary if an ASCII blank stands before it, no blank follows and both encodings have a
token that starts there: the tokenizer drops white space and no pre-token spans it, so what
precedes the place cannot change with the text to the right, nor what follows with the text to
the left.  Counts are spliced at the first such place.  If an overlap has none (long runs
without blanks), it is widened four times over and over, up to the rest of the document.

By the same proof every blank inside a single chunk is a stable boundary, so such a chunk is counted
by its runs between blanks, each distinct run being encoded once a task; no offsets are needed there.
The proof needs a tokenizer that drops white space; others are refused.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _pieces, default_tokenizer, slices
from .shared import tidy

BLANKS = " \t\n\r"
CHUNK, OVERLAP = 8192, 256
CACHED_RUNS = 400_000
#: Blank runs and what may stand around them; a tokenizer that drops white space gives the same ids for both sides.
PROBES = (("a b", "a  b"), ("it's .5 a", " it's\n\t.5  a "), ("<|endoftext|> b", "<|endoftext|>b"), (" ", ""))


def check_drops_blanks(tokenizer) -> None:
    """ValueError for a tokenizer whose ids depend on the white space between words: it has no boundary at a blank."""
    for one, other in PROBES:
        if tokenizer.encode(one, add_special_tokens=False).ids != tokenizer.encode(other, add_special_tokens=False).ids:
            raise ValueError("counts are spliced at blanks, which needs a tokenizer that drops white space")


class Counter:
    """Counts tokens as the library does, for a tokenizer that drops white space."""

    def __init__(self, spec: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}
        self.widened = self.spliced = 0
        check_drops_blanks(self.tokenizer)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: single chunks by their runs, longer texts by overlapping chunks."""
        rows = [None if len(t) > self.chunk + self.overlap else _pieces(t) for t in texts]
        wanted = {p for row in rows if row for p in row}
        unknown = {p for p in wanted if p not in self.known}
        if len(self.known) + len(unknown) > CACHED_RUNS:
            self.known.clear()
            unknown = wanted
        todo = list(unknown)
        for at in range(0, len(todo), 20_000):
            some = todo[at : at + 20_000]
            done = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update(zip(some, map(len, done)))
        known = self.known
        return [self.huge(t) if row is None else sum([known[p] for p in row]) for t, row in zip(texts, rows)]

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of one chunk start, in the whole text."""
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return [begin + a for a, _ in found.offsets]

    def huge(self, text: str) -> int:
        size, total, keep_from, begin = len(text), 0, 0, 0
        wide = self.overlap
        end = min(size, begin + self.chunk + wide)
        mine = self._starts(text, begin, end)
        while end < size:
            border = begin + self.chunk
            nxt_end = min(size, border + self.chunk + self.overlap)
            nxt = self._starts(text, border, nxt_end)
            place = self._stable(text, border, min(end, nxt_end), mine, nxt)
            while place is None and end < size:
                self.widened += 1
                wide *= 4
                end = min(size, begin + self.chunk + wide)
                mine = self._starts(text, begin, end)
                if nxt_end < end:
                    nxt_end = min(size, end + self.overlap)
                    nxt = self._starts(text, border, nxt_end)
                place = self._stable(text, border, end, mine, nxt)
            if place is None:
                break
            self.spliced += 1
            total += bisect_left(mine, place) - bisect_left(mine, keep_from)
            keep_from, begin, end, mine, wide = place, border, nxt_end, nxt, self.overlap
            # the next chunk may have been widened past its own border already
            wide = max(wide, end - begin - self.chunk)
        return total + len(mine) - bisect_left(mine, keep_from)

    @staticmethod
    def _stable(text: str, border: int, end: int, mine: list[int], nxt: list[int]) -> int | None:
        there = set(nxt[: bisect_left(nxt, end)])
        for place in mine[bisect_left(mine, border + 1) : bisect_left(mine, end)]:
            if text[place - 1] in BLANKS and place in there:
                return place
        return None


def count_tokens(
    docs: DataFrame,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Null and empty texts have no bytes and no tokens.  ``tokenizer`` is tokenizer JSON that drops white
    space, else ValueError.  Other columns are ignored; ids pass through as they are.
    """
    spec = tokenizer or default_tokenizer()
    Counter(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        counter = Counter(spec, chunk, overlap)
        gc.freeze()
        gc.disable()  # the memo holds no cycles
        try:
            yield from counted(counter, batches)
        finally:
            gc.enable()
            del counter
            tidy()

    def counted(counter: Counter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, 1, 2_000_000):
            n = counter.counts([t or "" for t in batch.column(1).to_pylist()])
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            cols = [batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
