"""BPE encoding and decoding by a prefix-sharing trie.

A token list is the BPE encoding of a word exactly when every neighbouring pair of its tokens is:
no merge of the pair's symbols may cross the border before both tokens are complete.
So the encoding of a prefix is its last token plus the encoding of what precedes it, and the last
token is the one vocabulary suffix whose border to the encoding before it holds.  Distinct new
words of a batch are inserted into a trie over byte symbols; a depth-first walk keeps the
last token of every prefix on the path, so a prefix shared by many words is encoded once.
The last symbol of a word is the ``</w>`` form of its byte, which is a node of its own.

Work is per task: no shuffle, no state beyond a bounded cache of pieces.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import tidy

CACHED_PIECES, TRIE_WORDS = 220_000, 16_000
#: Characters from which a word is walked by itself, without a trie, and is not kept in the caches.
LONG = 512


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where it prints, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


class _Tail:
    """The trie of a single long word, one node at a time."""

    __slots__ = ("raw", "at", "word")

    def __init__(self, raw: bytes, at: int, word: str):
        self.raw, self.at, self.word = raw, at, word

    def items(self) -> tuple:
        raw, at = self.raw, self.at
        if at == len(raw):
            return ((-1, self.word),)
        return ((raw[at] + 256 * (at + 1 == len(raw)), _Tail(raw, at + 1, self.word)),)


class TrieBpe:
    """Encoder and decoder for a word-end BPE vocabulary given as tokenizer JSON."""

    def __init__(self, spec: str, cached: int = CACHED_PIECES):
        import regex

        data = json.loads(spec)
        self.cached = cached
        self.suffix = data["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.added = added
        self.added_at = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) or r"(?!)")
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_at = regex.compile(pattern)
        self._library(data)
        self.symbols = byte_symbols()
        # a symbol is a number: the byte, plus 256 for its word-end form
        number = {c: b for b, c in enumerate(self.symbols)}
        end = len(self.suffix)

        def spell(token: str) -> tuple[int, ...]:
            if token.endswith(self.suffix) and len(token) > end:
                body = [number[c] for c in token[:-end]]
                return (*body[:-1], body[-1] + 256)
            return tuple(number[c] for c in token)

        spelt = {i: spell(t) for t, i in vocab.items()}
        self.token_of = {s: i for i, s in spelt.items()}
        self.length = {i: len(s) for i, s in spelt.items()}
        self.longest = max(self.length.values())
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.token_of[spelt[a] + spelt[b]]
            if (a, b) not in self.merges:
                self.merges[a, b] = (rank, made)
                self.halves.setdefault(made, (a, b))
        self.rank = {made: rank for rank, made in self.merges.values()}
        self.fits: dict[tuple[int, int], bool] = {}
        # tokens spelt backwards, as nested dicts; -1 holds the token that ends there
        self.backwards: dict = {}
        for spelling, token in self.token_of.items():
            node = self.backwards
            for s in reversed(spelling):
                node = node.setdefault(s, {})
            node[-1] = token
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.proper: dict[int, bool] = {}
        self.long: list[str] = []

    def _library(self, data: dict) -> None:
        """The library's own normalizer and word split, for what is not ASCII: it follows a Unicode version of its own."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        bare = data | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        first = data["pre_tokenizer"]["pretokenizers"][0]
        self.normal = Tokenizer.from_str(json.dumps(bare)).normalizer
        self.split = pre_tokenizers.Split(Regex(first["pattern"]["Regex"]), first["behavior"].lower(), first["invert"])
        # Latin letters that both sides treat alike, asked here; none of them composes with what stands before it
        alike = "".join(c for c in map(chr, range(0x80, 0x300)) if c.isalpha() and len(c.lower()) == 1 and self._library_words(f"a{c}a") == [f"a{c.lower()}a"])
        self.plain = re.compile(rf"[\x00-\x7f{alike}]*\Z")

    def _library_words(self, piece: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(piece))]

    def _merge(self, symbols: list[int]) -> list[int]:
        """Plain merging of token ids, used only to settle one border of two tokens."""
        parts = list(symbols)
        while len(parts) > 1:
            ranked = [(self.merges[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.merges]
            if not ranked:
                break
            rank, k = min(ranked)
            made = self.merges[parts[k], parts[k + 1]][1]
            parts[k : k + 2] = [made]
        return parts

    def _border_holds(self, a: int, b: int, key: tuple[int, int]) -> bool:
        """Whether the symbols of ``a`` and ``b`` together are encoded as exactly these two tokens.

        Merges are undone from the last one on; the border fails if the two pieces that face it could
        have merged before the merge that hid one of them.
        """
        merges, rank, halves = self.merges, self.rank, self.halves
        limit = len(merges) + 1
        while True:
            made = merges.get((a, b))
            if made is not None and made[0] < limit:
                held = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra == rb == -1:
                held = True
                break
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]
        if len(self.fits) > 2 * self.cached + 60_000:
            self.fits.clear()
        self.fits[key] = held
        return held

    def spelling(self, token: int) -> tuple[int, ...]:
        if token in self.halves:
            a, b = self.halves[token]
            return self.spelling(a) + self.spelling(b)
        return self._base[token]

    @property
    def _base(self) -> dict[int, tuple[int, ...]]:
        if not hasattr(self, "_base_of"):
            self._base_of = {i: s for s, i in self.token_of.items() if len(s) == 1}
        return self._base_of

    def _is_proper(self, token: int) -> bool:
        """Whether the token's own symbols are encoded as the token."""
        if token not in self.proper:
            self.proper[token] = self._merge([self.token_of[(s,)] for s in self.spelling(token)]) == [token]
        return self.proper[token]

    def encode_words(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Id bytes and decoded bytes of distinct words, in tries of neighbours in sorted order.

        A long word shares little and its nodes would cost a hundred bytes a symbol, so it has no stored trie.
        """
        order, out = sorted(w for w in words if len(w) <= LONG), {}
        most = min(TRIE_WORDS, self.cached // 10 + 1)
        for word in words:
            if len(word) > LONG:
                out |= self._search(_Tail(word.encode("utf-8"), 0, word))
        for at in range(0, len(order), most):
            out |= self._walk(order[at : at + most])
        return out

    def _walk(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The trie of distinct words, and their encodings from it."""
        root: dict = {}
        for word in words:
            raw = word.encode("utf-8")
            node = root
            for s in raw[:-1]:
                node = node.setdefault(s, {})
            node.setdefault(raw[-1] + 256, {})[-1] = word
        return self._search(root)

    def _search(self, root: dict | _Tail) -> dict[str, tuple[bytes, bytes]]:
        """Encodings of all words of a trie by a depth-first walk."""
        out: dict[str, tuple[bytes, bytes]] = {}
        fits, backwards, length, names = self.fits, self.backwards, self.length, self.names
        path: list[int] = []
        last: list[int] = []  # last token of every prefix on the path
        todo: list[tuple[int, int, dict]] = [(0, s, n) for s, n in root.items()]
        while todo:
            depth, symbol, node = todo.pop()
            del path[depth:], last[depth:]
            path.append(symbol)
            size = depth + 1
            ends = []  # vocabulary suffixes of the prefix, the shortest first
            at, back = depth, backwards.get(symbol)
            while back is not None:
                token = back.get(-1)
                if token is not None:
                    ends.append(token)
                at -= 1
                if at < 0:
                    break
                back = back.get(path[at])
            while ends:
                token = ends.pop()
                n = length[token]
                if n == size:
                    held = self._is_proper(token)
                else:
                    key = (last[depth - n], token)
                    held = fits.get(key)
                    if held is None:
                        held = self._border_holds(*key, key)
                if held:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            for s, child in node.items():
                if s == -1:
                    ids = []
                    at = size
                    while at:
                        ids.append(last[at - 1])
                        at -= length[ids[-1]]
                    ids.reverse()
                    out[child] = (array("I", ids).tobytes(), " ".join([names[i] for i in ids]).encode())
                else:
                    todo.append((size, s, child))
        return out

    def words_in(self, piece: str) -> list[str]:
        """Normalised words of a piece (white space separates words either way)."""
        if piece.isascii() or self.plain.match(piece):
            text = piece.lower()
            return [text] if text.isalpha() else self.word_at.findall(text)  # letters alone are one word
        return self._library_words(piece)

    def _learn(self, fresh: set[str]) -> None:
        """Add pieces (runs without ASCII white space) to the cache, as id bytes and decoded bytes."""
        marked = {p for p in fresh if p[0] == " "}
        for p in marked:
            self.pieces[p] = (array("I", [self.added[p[1:]]]).tobytes(), p[1:].encode())
        split: dict[str, list[str]] = {}
        for piece in fresh - marked:
            split[piece] = self.words_in(piece)
        words, pieces = self.words, self.pieces
        unknown = {w for ws in split.values() for w in ws if w not in words}
        self.long = [w for w in unknown if len(w) > LONG]
        words.update(self.encode_words(unknown))
        for piece, parts in split.items():
            if len(parts) == 1:
                pieces[piece] = words[parts[0]]
            else:
                got = [words[w] for w in parts]
                pieces[piece] = (b"".join([g[0] for g in got]), b" ".join([g[1] for g in got]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        rows = [self._parts(t) for t in texts]
        wanted = {p for row in rows for p in row}
        fresh = {p for p in wanted if p not in self.pieces}
        if len(self.pieces) + len(fresh) > self.cached:
            self.pieces.clear()
            self.words.clear()
            fresh = wanted
        self._learn(fresh)
        pieces = self.pieces
        out = []
        for row in rows:
            got = [pieces[p] for p in row]
            out.append((b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])))
        for piece in [p for p in fresh if len(p) > LONG]:  # the caches are bounded in bytes as well
            del pieces[piece]
        if self.long:
            for word in self.long:
                self.words.pop(word, None)
            self.long.clear()
        return out

    def _parts(self, text: str) -> list[str]:
        """Pieces of a text; a special token is a piece of its own, marked by a leading blank."""
        if "<" not in text or not (found := list(self.added_at.finditer(text))):
            return _pieces(text)
        out, at = [], 0
        for m in found:
            out += [*_pieces(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return out + _pieces(text[at:])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: what the vocabulary's own decoder, which is none, gives."""
        return " ".join(self.names[i] for i in array("I", ids))

    def words_of(self, ids: bytes) -> str:
        """Readable words: pieces joined, bytes restored, one space where a word ends."""
        number = {c: b for b, c in enumerate(self.symbols)}
        text = "".join(self.names[i].replace(self.suffix, " ") for i in array("I", ids))
        return bytes(32 if c == " " else number[c] for c in text).decode("utf-8", "replace").rstrip(" ")


def _pieces(text: str) -> list[str]:
    """Runs between ASCII blanks; other white space is left to the word pattern."""
    if "\n" in text or "\t" in text or "\r" in text:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return [p for p in text.split(" ") if p]


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        start = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep_ids: bool = True, keep_decoded: bool = True,
    cached: int = CACHED_PIECES,
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    Null and empty texts have no tokens.  Ids or decoded texts that are not kept stay in the task and only their
    digests come out.  Other columns are ignored.  ``cached`` bounds the pieces a task remembers: it trades
    memory for time and changes no result.
    """
    spec = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        bpe = TrieBpe(spec, cached)
        tidy()  # what reading the vocabulary left behind
        gc.freeze()
        gc.disable()  # tries and caches hold no cycles, and walking them costs a quarter of the time
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()
            del bpe
            tidy()

    def encoded(bpe: TrieBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        from itertools import accumulate

        for batch in slices(batches, 1, min(2_000_000, 10 * cached)):
            done = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            sizes = [len(a) // 4 for a, _ in done]
            cols = [batch.column(0), pa.array(sizes, pa.int64())]
            if keep_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join([a for a, _ in done]))])
                cols.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), flat))
            if keep_decoded:
                cols.append(pa.array([b.decode() for _, b in done]))
            cols += [pa.array([sha256(x[k]).hexdigest() for x in done]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    middle = "ids array<int>, " * keep_ids + "decoded string, " * keep_decoded
    schema = f"doc_id {kind}, n_tokens long, {middle}ids_sha256 string, decoded_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, schema)
