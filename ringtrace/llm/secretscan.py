"""Secret scans: fixed patterns plus values in credential contexts that are costly to guess.

Cost is the number of guesses of an attacker who knows how people make passwords.  A value is
cut into the cheapest sequence of words, dates, repeats, keyboard walks, runs of the alphabet and
brute-force spans by dynamic programming over its characters; the cost of a
sequence is the product of the parts' costs, and brute force costs a power of the alphabet for each
character.  Values from ``10**bits`` guesses on are reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .shared import cut, drop, tidy

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names that announce a credential, a separator, an authorization scheme if there is one, and a value up to a blank or a
#: closing quote; a bearer scheme without a header's name announces values of 20 characters or more.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|passphrase|pwd|secret|token|credentials?|auth(?:orization)?|bearer|"""
    r"""(?:api|access|private|client|encryption)[_-]?key)["']?\x20*(?:is(?=[\x20"'])|=>|:=|[:=])\x20*(?:(?:bearer|basic|digest|token|apikey)\x20+)?"""
    r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>,;]{6,}))|\bbearer\x20+([^\s"'<>,;]{20,}))""",
    re.IGNORECASE | re.ASCII,
)
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "credential", "auth", "bearer", "key")

#: Words that people put into passwords, most common first; the corpus adds its own.
WORDS = (
    "password the qwerty and love you admin for welcome not monkey with dragon this letmein that login from "
    "master have sunshine princess football shadow superman secret test user root change default guest "
    "hello summer winter spring autumn baseball computer internet server money freedom whatever trust "
    "batman michael jordan jennifer thomas robert daniel ashley charlie jessica andrew george hunter "
    "killer pepper ginger cookie cheese flower orange purple yellow silver golden diamond phoenix thunder "
    "access system manager office company service account private public token example sample demo dev prod "
    "please enter your here todo none null true false changeme placeholder redacted hidden value string"
).split()
RANK = {w: n + 1 for n, w in enumerate(WORDS)}
LONGEST_WORD = 24
#: Words as the corpus writes them: runs of letters that no letter, digit or underscore continues.
LETTERS = re.compile(rf"\b[^\W\d_]{{3,{LONGEST_WORD}}}\b")
#: The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4@310$57!", "aaeiossti")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
PLACES = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


def _near(a: str, b: str) -> bool:
    if a not in PLACES or b not in PLACES or a == b:
        return False
    (r, k), (s, m) = PLACES[a], PLACES[b]
    return abs(r - s) <= 1 and abs(k - m) <= 1


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def _run_lengths(n: int, holds: Callable[[int], bool]) -> list[int]:
    """For each place, how many places from there on hold without a break."""
    out = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        out[k] = out[k + 1] + 1 if holds(k) else 0
    return out


def guess_cost(value: str, enough: float = float("inf"), ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation; 0 for an empty value.

    A word in ``ranks`` takes about as many guesses as its rank.

    Time is linear in the value.  Once the value is proven to cost ``enough`` or more, a lower bound of at
    least ``enough`` is returned instead: every segmentation has its first cut after a place between
    there and the end of the longest part that starts before it.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [float("inf")] * n
    again = [_run_lengths(n, lambda k, u=u: k + u < n and low[k] == low[k + u]) for u in range(1, 9)]
    steps = [_run_lengths(n, lambda k, d=d: k + 1 < n and value[k + 1].isalnum() and ord(value[k + 1]) - ord(value[k]) == d) for d in (1, -1)]
    walked, walking = 0, float("inf")  # neighbouring keys before a place, cheapest walk of four or more keys that ends there
    end = 1

    def offer(i: int, j: int, guesses: float) -> None:
        nonlocal end
        cost = best[i] + log10(guesses)
        if cost < best[j]:
            best[j] = cost
        end = max(end, j)

    for i in range(n):
        offer(i, i + 1, _alphabet(value[i]) * (1 if value[i] == low[i] else 2))
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            for form, extra in ((low, 1), (plain, 4)):
                if form[i:j] in ranks:
                    offer(i, j, (ranks[form[i:j]] + 1) * extra * (1 if value[i:j] == low[i:j] else 4))
        for m in (DATE.match(value, i),):
            if m:
                offer(i, m.end(), 365 * 120 if m.end() - i > 4 else 120)
        for unit in range(1, min(8, (n - i) // 2) + 1):
            j = i + unit + again[unit - 1][i] // unit * unit
            if j - i >= max(3, 2 * unit):
                offer(i, j, max(2.0, 10 ** min(2 * unit, 16)) * ((j - i) // unit))
        walked = walked + 1 if i and _near(low[i - 1], low[i]) else 0
        walking = min(walking + log10(3), best[i - 3] + log10(40 * 3)) if walked >= 3 else float("inf")
        best[i + 1] = min(best[i + 1], walking)
        for run in steps:
            j = i + 1 + run[i]
            if j - i >= 3:
                offer(i, j, 60 * (j - i))
        if i % 16 == 15 and end - i < 256:
            least = min(walking, *best[max(0, i - 2) : end + 1])
            if least >= enough:
                return least
    return best[n]


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds in listed order, leftmost and non-overlapping within a kind."""
    low = text.lower() if low is None else low
    found = []
    if any(h in low for h in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def cost_spans(text: str, least: float, low: str | None = None, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """Values in credential contexts that take at least ``10**least`` guesses, as kind ``guess``."""
    low = text.lower() if low is None else low
    if not any(h in low for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        value = m[k].rstrip(".)]}") if k >= 3 else m[k]
        if len(value) >= 6 and guess_cost(value, least, ranks) >= least:
            found.append(("guess", m.start(k), m.start(k) + len(value)))
    return found


def word_ranks(docs: DataFrame, text_col: str = "text", most: int = 50_000, least_docs: int = 3) -> dict[str, int]:
    """Word to rank by document frequency over the whole corpus, the fixed words included at their own ranks.

    At most ``most`` words come to the driver: a histogram of the counts' logarithms (a few thousand
    rows) gives the smallest count that leaves no more, and words of fewer documents stay out.
    Values in credential contexts are not counted, so a secret that is copied does not become a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text:
                    low = text.lower()
                    if any(h in low for h in HINTS):
                        low = CONTEXT.sub(" ", low)
                    seen.update(set(LETTERS.findall(low)))
            if len(seen) > 200_000:
                yield flush()
        yield flush()
        tidy()

    counts = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(counts.where(F.col("n") >= least_docs).withColumn("size", F.floor(F.log2("n") * 64).cast("int")), "secret-words")
    least, held = None, 0
    for r in sorted(words.groupBy("size").count().collect(), reverse=True):
        if held + r["count"] > most:
            break
        least, held = r["size"], held + r["count"]
    rows = words.where(F.col("size") >= least).select("word", "n").collect() if held else []  # at most ``most``
    drop(words)
    found = {r.word: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.word)))}
    return found | {w: min(n, found.get(w, n)) for w, n in RANK.items()}


ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def scan(docs: DataFrame, least: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans), one row for each row of ``docs``.

    ``base`` lists the spans of the fixed kinds, ``spans`` all, as ``kind:start:end`` in code points, end
    exclusive, by start and kind.  Null and empty texts have none.  Other columns are ignored.
    Words are ranked over all of ``docs``.
    """
    ranks = word_ranks(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                low = text.lower()
                base = base_spans(text, low)
                kinds = [k for k, _, _ in base]
                rows.append(([kinds.count(k) for k in ("assign", "access", "hex")], joined(base), joined(base + cost_spans(text, least, low, ranks))))
            cols = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
            cols += [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string"
    )


def redact_text(text: str, least: float, mark: str, ranks: dict[str, int] = RANK) -> str:
    """``text`` with every span replaced by ``mark``; overlapping spans are one."""
    low = text.lower()
    spans = sorted((a, b) for _, a, b in base_spans(text, low) + cost_spans(text, least, low, ranks))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, least: float = 10.0, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced; all rows and columns stay, and ``n_chars``, if there, counts anew."""
    ranks = word_ranks(docs, text_col)
    names = docs.columns
    at = names.index(text_col)
    counted = names.index("n_chars") if "n_chars" in names else None
    kind = docs.schema["n_chars"].dataType.simpleString() if counted is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            cols = list(batch.columns)
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact_text(t, least, mark, ranks) for t in old]
            cols[at] = pa.array(new, batch.column(at).type)
            if counted is not None and kind in ("bigint", "int"):
                same = batch.column(counted).to_pylist()
                sizes = [c if a == b else len(b) for c, a, b in zip(same, old, new)]
                cols[counted] = pa.array(sizes, batch.column(counted).type)
            yield pa.RecordBatch.from_arrays(cols, names)
        tidy()

    return docs.mapInArrow(run, docs.schema)
