"""Byte-level BPE encoding and decoding: longest matches, backtracking, compatible neighbours.

A token list is what merging by rank gives exactly when every two neighbours are: the encoding of
their joined bytes is the two of them.  So a piece is encoded from left to right: at each place the
longest token that starts there (found for all places by one pass of an Aho-Corasick automaton over
the bytes written as Latin-1) is taken if it is compatible with the token before; else the next
shorter one; with none left the last token is taken back and its end is marked dead.  No place is
entered twice from the same side, so the time is linear in the piece.  Compatibility is memoised by
pair of tokens.

The pattern is matched with explicit sets of letters, numbers and white space.  ASCII is fixed; the class of
any other character is asked of the library's own pattern engine once it turns up, because
engines follow different versions of Unicode.  Each distinct match is encoded once a task.

Work is per task: no shuffle, no state beyond bounded memos.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import slices
from .shared import tidy

#: Pieces a task remembers, pairs whose compatibility it remembers, and bytes from which a piece is not remembered.
CACHED_PIECES, CACHED_PAIRS, LONG = 300_000, 1_000_000, 256


def read_ranks(spec: str) -> list[bytes]:
    """Token bytes by rank from lines of base64 and rank; ranks run from 0 without gaps, else ValueError."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in spec.splitlines() if line.strip())}
    if sorted(found) != list(range(len(found))) or not {bytes([b]) for b in range(256)} <= set(found.values()):
        raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
    return [found[k] for k in range(len(found))]


def default_ranks() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _ranges(points: set[int]) -> str:
    """Code points as the inside of a character set, neighbours as ranges."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


class Splitter:
    """Matches of the vocabulary's pattern, with the character classes of the library's engine."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.seen: set[str] = set()
        self.classes: dict[str, set[int]] = {"a": set(), "1": set(), " ": set(), "!": set()}
        self._compile()

    def _compile(self) -> None:
        letter, number, blank = (known + _ranges(self.classes[k]) for k, known in (("a", "A-Za-z"), ("1", "0-9"), (" ", r"\t-\r ")))
        # the fixed pattern of these vocabularies, its classes written out
        self.find = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
        )

    def learn(self, texts: list[str]) -> None:
        """Class the characters not met before: one is a letter if the engine keeps it with a letter before it, and so on."""
        import tiktoken

        new = {c for t in texts if not t.isascii() for c in set(t) if c > "\x7f"} - self.seen
        if not new:
            return
        self.seen |= new
        probes = {f"{before}{c}".encode(): k for k, (before, c) in enumerate(((b, c) for c in new for b in "a1!"), 256)}
        engine = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | probes, special_tokens={})
        for c in new:
            kept = [b for b in "a1!" if len(engine.encode_ordinary(b + c)) == 1]
            self.classes[kept[0] if kept else " "].add(ord(c))
        self._compile()

    def split(self, texts: list[str]) -> list[list[str]]:
        self.learn(texts)
        return [self.find.findall(t) for t in texts]


class ByteBpe:
    """Encoder and decoder for a byte-level vocabulary given as ranks."""

    def __init__(self, tokens: list[bytes], pattern: str, halves: tuple[bytes, bytes] | None = None, cached: int = CACHED_PIECES):
        import ahocorasick

        self.tokens, self.cached = tokens, cached
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.shorter = array("i", (self._prefix(t) for t in tokens))
        self.fits: dict[tuple[int, int], bool] = {}
        if halves is None:
            self.left, self.right = self._halve()
        else:
            self.left, self.right = array("i", halves[0]), array("i", halves[1])
        self.made = {(a, b): k for k, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        self.find = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            if len(t) == 1 or self.left[k] >= 0:  # tokens that merging never makes are found as whole pieces only
                self.find.add_word(t.decode("latin-1"), (len(t) - 1, k))
        self.find.make_automaton()
        self.splitter = Splitter(pattern)
        self.known: dict[str, tuple[str, bytes, int]] = {}

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.rank:
                return self.rank[token[:n]]
        return -1

    def _halve(self) -> tuple[array, array]:
        """The two tokens whose merge makes each token: the only split whose parts are compatible so far."""
        self.left, self.right, self.made = array("i"), array("i"), {}
        for k, token in enumerate(self.tokens):
            found = (-1, -1)
            a = self.shorter[k]
            while a >= 0:
                b = self.rank.get(token[self.length[a] :], -1)
                if 0 <= b < k and a < k and self._proper(a) and self._proper(b) and self._compatible(a, b):
                    found = (a, b)
                    break
                a = self.shorter[a]
            self.left.append(found[0])
            self.right.append(found[1])
            if found[0] >= 0:
                self.made[found] = k
        return self.left, self.right

    def _proper(self, token: int) -> bool:
        return self.length[token] == 1 or self.left[token] >= 0

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both together are encoded as these two tokens.

        Merges are undone from the last on; at each step the two parts that face the border must not
        have merged before the merge that hides one of them.
        """
        made, left, right = self.made, self.left, self.right
        limit = len(self.tokens) + 1
        while True:
            if made.get((a, b), limit) < limit:
                return False
            undo_a, undo_b = left[a] >= 0, left[b] >= 0
            if undo_a and (a > b or not undo_b):
                limit, a = a, right[a]
            elif undo_b:
                limit, b = b + 1, left[b]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [0] * size
        for end, (back, token) in self.find.iter(piece.decode("latin-1")):
            longest[end - back] = token  # ends come in order, so the longest of a start is the last
        length, shorter, fits = self.length, self.shorter, self.fits
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + length[token]
            held = alive[end]
            if held and out:
                pair = (out[-1], token)
                held = fits.get(pair)
                if held is None:
                    held = fits[pair] = self._proper(token) and self._compatible(*pair)
            elif held:
                held = self._proper(token)
            if held:
                out.append(token)
                at = end
                if at < size:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes, int]]:
        """For each text its decimal ids joined by blanks, its ids as 32-bit integers and their number."""
        rows = self.splitter.split(texts)
        wanted = {p for row in rows for p in row}
        known = self.known
        new = [p for p in wanted if p not in known]
        if len(known) + len(new) > self.cached:
            known.clear()
            new = list(wanted)
        for p in new:
            ids = self.encode_piece(p.encode())
            known[p] = (" ".join(map(str, ids)), array("i", ids).tobytes(), len(ids))
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        for row in rows:
            got = [known[p] for p in row]
            yield " ".join([g[0] for g in got]), b"".join([g[1] for g in got]), sum([g[2] for g in got])
        for p in new:  # the memo is bounded in bytes as well
            if len(p) > LONG:
                del known[p]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of 32-bit ids."""
        tokens = self.tokens
        return b"".join([tokens[k] for k in array("i", ids)])


_halves: dict[str, tuple[bytes, bytes]] = {}


def halves_of(spec: str) -> tuple[bytes, bytes]:
    """Halves of every token, worked out once in the driver: two integers a token of the vocabulary."""
    if spec not in _halves:
        made = ByteBpe(read_ranks(spec), default_pattern())
        _halves[spec] = (made.left.tobytes(), made.right.tobytes())
    return _halves[spec]


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, keep_ids: bool = True, keep_decoded: bool = True,
    cached: int = CACHED_PIECES,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    ``ids_sha256`` is of the decimal ids joined by one blank, ``decoded_sha256`` of the decoded bytes.  Null and
    empty texts have no tokens and digests of nothing.  ``ranks`` are lines of base64 token and rank for the pattern
    of ``public_tokenizers``.  Ids or decoded texts that are not kept stay in the task.  Repeated and null ids keep
    their rows; other columns are ignored, whatever their names.  ``cached`` bounds the pieces a
    task remembers and changes no result.
    """
    spec, pattern = ranks or default_ranks(), default_pattern()
    tokens, halves = read_ranks(spec), halves_of(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        bpe = ByteBpe(tokens, pattern, halves, cached)
        tidy()
        gc.freeze()
        gc.disable()  # the memos hold no cycles
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()
            del bpe
            tidy()

    def encoded(bpe: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        from itertools import accumulate

        for batch in slices(batches, 1, 2_000_000):
            counts, ids, decoded, sha_ids, sha_decoded = [], [], [], [], []
            for decimal, raw, n in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                back = bpe.decode(raw)
                counts.append(n)
                sha_ids.append(sha256(decimal.encode()).hexdigest())
                sha_decoded.append(sha256(back).hexdigest())
                if keep_ids:
                    ids.append(raw)
                if keep_decoded:
                    decoded.append(back.decode())
            cols = [batch.column(0), pa.array(counts, pa.int64())]
            if keep_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(ids))])
                cols.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), flat))
            if keep_decoded:
                cols.append(pa.array(decoded, pa.string()))
            cols += [pa.array(sha_ids, pa.string()), pa.array(sha_decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    middle = "ids array<int>, " * keep_ids + "decoded string, " * keep_decoded
    schema = f"doc_id {kind}, n_tokens long, {middle}ids_sha256 string, decoded_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(doc_id, decoded) from arrays of ids; null arrays decode to the empty text, broken UTF-8 to U+FFFD, unknown ids are an error."""
    tokens = read_ranks(ranks or default_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([tokens[k] for k in row or ()]).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, decoded string")
