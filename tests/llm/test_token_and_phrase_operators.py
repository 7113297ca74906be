"""Operators 11 to 13 against brute force on small tables, and their edge cases."""

import random
from array import array
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ringtrace.llm import align, bpe, bytebpe, phrases, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, "   \n"), (4, " "), (5, "one"), (6, " two  blanks "), (7, "same words here again"), (7, "same words here again"),
    (None, "same words here again"), (8, "x " * 60_000), (9, "é日本😀 don't STOP 123 ՘ Ᲊ"), (10, "a▁b c"), (11, "<|endoftext|> </s> <0x41>"), (None, None),
    (12, "abcdefghij" * 20_000), (13, "\x00 tab\t\tlast\n\n"), (14, "a  b  c"),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None if t and len(t) % 2 else "en", "s", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def random_texts(seed, n, most):
    rng = random.Random(seed)
    parts = [*"abcdefgh ABC012 .,'!?\n\t\r  éß日本😀½٣՘Ᲊ́\x1c\x85 ", "'s", "'ll", "don't", "  ", "\n\n", " \n", "<s>", "<|endoftext|>", " the", " of"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


# ---- 13 byte-level BPE
def library(tokens):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})


def test_bytes_are_encoded_as_by_the_library(spark):
    engine = library(bytebpe.read_ranks(bytebpe.default_ranks()))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = engine.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("kept", [None, 300, 3000])
def test_every_piece_is_merged_by_rank(kept):
    tokens = bytebpe.read_ranks(bytebpe.default_ranks())
    if kept:
        tokens = [*tokens[:kept], b"xqzjv", b" qqqq", b"bcd"]  # tokens that no merge may make
    bpe = bytebpe.ByteBpe(tokens, P.PATTERN)
    engine = library(tokens)
    texts = [*random_texts(1, 3000, 50), "xqzjv", "axqzjv", " qqqq", "bcd abcd bcd", "a" * 3000, " " * 2000 + "b", "日本" * 500]
    texts += ["x" + "".join(map(chr, range(c, c + 40))) + " 1" for c in range(0x80, 0xD000, 997)]
    for text, (decimal, raw, n) in zip(texts, bpe.encode(texts)):
        ids = engine.encode_ordinary(text)
        assert list(array("i", raw)) == ids and decimal == " ".join(map(str, ids)) and n == len(ids) and bpe.decode(raw) == text.encode()


def test_small_memo_changes_nothing():
    tokens = bytebpe.read_ranks(bytebpe.default_ranks())
    texts = random_texts(2, 300, 60)
    wide, narrow = bytebpe.ByteBpe(tokens, P.PATTERN), bytebpe.ByteBpe(tokens, P.PATTERN, cached=5)
    assert [x for t in texts for x in narrow.encode([t])] == list(wide.encode(texts))


def test_odd_rows_round_trip(odd, empty):
    rows = bytebpe.encode_documents(odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(""))).collect()
    assert sorted(((r.doc_id or -1), r.decoded) for r in rows) == sorted(((i or -1), t or "") for i, t in ODD)
    assert all(len(r.ids) == r.n_tokens for r in rows)
    back = bytebpe.decode_documents(bytebpe.encode_documents(odd)).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in ODD)
    assert bytebpe.encode_documents(empty).count() == 0
    with pytest.raises(ValueError):
        bytebpe.read_ranks("YQ== 0\nYg== 2")


# ---- 4 word-end BPE
def test_words_follow_the_library_on_every_kind_of_character():
    spec = bpe.default_tokenizer()
    engine = Tokenizer.from_str(spec)
    engine.no_truncation()
    engine.no_padding()
    chars = [chr(c) for c in (*range(0x80, 0xD800, 11), *range(0xE000, 0x110000, 211), 0x558, 0x88F, 0x1C89, 0x130, 0x3A3)]
    texts = ["".join(f"Ab{c}Cd 1{c}2{c}" for c in chars[k : k + 4]) for k in range(0, len(chars), 4)]
    texts += ["x\u0301\u1df6y", "a\U0001e4ec\u0301 b\U0001e4ed\u0301", *random_texts(8, 500, 40)]
    want = [e.ids for e in engine.encode_batch(texts, add_special_tokens=False)]
    assert [list(array("I", a)) for a, _ in bpe.TrieBpe(spec).encode(texts)] == want


# ---- 11 alignment
def test_galloping_finds_what_two_lists_share():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = (sorted(rng.sample(range(300), rng.randrange(n))) for n in (rng.choice([3, 40]), rng.choice([3, 250])))
        assert list(zip(*align.common_ranks(a, b))) == [(a.index(c), b.index(c)) for c in sorted({*a} & {*b})]


def aligned(texts):
    """Plain alignment of whole texts, as the rows that must come out in order."""
    first, second = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    first.encode_special_tokens = True
    show = {c: b for b, c in enumerate(align.byte_symbols())}
    rows, held = [], []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        raw_a = [bytes(show[c] for c in first.id_to_token(k)) for k in a]
        raw_b = [align.Aligner._piece(second.id_to_piece(k)) for k in b]
        links, shown = Counter(), []
        if text and b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
            i = j = 0
            for end in sorted({*ends_a} & {*ends_b}):
                i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
                shown.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
                links.update((x, y) for x in a[i:i2] for y in b[j:j2])
                i, j = i2, j2
            rows.append([len(a), len(b), len(shown), sum(links.values())])
        else:
            rows.append([0, 0, 0, 0])
        rows[-1].append(sha256(";".join(shown).encode()).hexdigest() if shown else "")
        held.append(links)
    count = Counter(p for links in held for p in links)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [(*r[:4], sum(n for p, n in x.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in x.items()), r[4]) for r, x in zip(rows, held)]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, aligned([d.text or "" for d in docs]))}
    got = queries.op11_token_alignment(spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in ALIGNED) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block_bytes", [1, 3000])
def test_alignment_of_odd_texts_in_small_blocks(spark, block_bytes):
    rows = [*ODD, *enumerate(random_texts(5, 150, 40), 100), (15, None)]
    docs = documents(spark, rows).withColumn("block", F.lit(1)).withColumn("n_a", F.lit(2)).repartition(3)
    got = align.align_documents(docs, block_bytes=block_bytes, cached=50).collect()
    want = aligned([t or "" for _, t in rows])
    assert sorted((str(r.doc_id), *[r[c] for c in ALIGNED]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_alignment_of_nothing(empty, spark):
    assert align.align_documents(empty).count() == 0
    rows = align.align_documents(documents(spark, [(1, None), (2, "")])).collect()
    assert {tuple(r[c] for c in ALIGNED) for r in rows} == {(0, 0, 0, 0, 0, 0, "")} and len(rows) == 2


# ---- 12 phrases
def test_dense_and_listed_tiles_agree():
    rng = np.random.default_rng(1)
    i, j = (np.concatenate([rng.integers(0, 6, 3000), rng.integers(0, 60, 500), rng.integers(0, 1 << 31, 50)]) for _ in range(2))
    want = Counter(zip(i.tolist(), j.tolist()))
    for tile in (4, 1024):
        keys, counts = phrases.count_pairs(i, j, tile)
        assert {(k >> 32, k & (1 << 32) - 1): n for k, n in zip(keys.tolist(), counts.tolist())} == want and (np.diff(keys) > 0).all()
    assert not len(phrases.count_pairs(i[:0], j[:0])[0])


def mined(rows, least, longest, share):
    total, f = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for stop in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(stop, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    found = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    over = Counter()
    for (lang, w), n in found.items():
        for m in range(2, len(w)):
            for k in range(len(w) - m + 1):
                over[lang, w[k : k + m]] = max(n, over[lang, w[k : k + m]])
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in over and 100 * over[lang, w] >= share * a:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], total[lang]))
    return sorted((lang, n, w.decode(), -a, l, r, t, -s) for lang, rows in out.items() for n, (s, a, w, l, r, t) in enumerate(sorted(rows), 1))


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, longest, share, block_bytes", [(2, 5, 100, 1), (3, 3, 70, 400), (2, 2, 100, 10_000)])
def test_phrases_equal_counting(spark, least, longest, share, block_bytes):
    rng = random.Random(least)
    words = ["New", "york", "city", "the", "of", "é", "日本", "a b", "\x00", "x"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\n", "\t", "  "]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" \n..", "fr"), ("new york city new york city", "en"), ("word " * 300, "en"), ("a" * 50_000 + " b", "en")]
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.withColumn("id", F.lit(1)).withColumn("word", F.lit(2)).withColumn("block", F.lit(3)).repartition(3)
    got = phrases.collocations(docs, least=least, longest=longest, inside_share=share, top=None, block_bytes=block_bytes).collect()
    assert sorted(tuple(r[c] for c in PHRASE) for r in got) == mined(rows, least, longest, share)


def test_phrases_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES["op12_phrase_collocations"])
    got = queries.op12_phrase_collocations(spark, SF)
    assert want.columns == got.columns and sorted(want.fetchall()) == sorted(map(tuple, got.collect()))


def test_phrases_exact_beyond_64_bits_and_top(spark):
    docs = spark.createDataFrame([("a b c d",)] * 4 + [("x y",)] * 3 + [("lone",)], "text string").withColumn("lang", F.lit(None).cast("string"))
    got = phrases.collocations(docs, least=2, top=1).collect()
    assert [tuple(r) for r in got] == [("und", 1, "x y", 3, 3, 3, 23, 7666)]
    wide = spark.createDataFrame([(0, "en", "a b", "b", [9 * 10**12, 8 * 10**12], [9 * 10**12, 8 * 10**12], 8 * 10**12)], "id long, lang string, phrase string, last string, pre array<long>, suf array<long>, f long")
    n = 15 * 10**12
    score = phrases._scored(wide, None, spark.createDataFrame([("en", n)], "lang string, n long"), 100).first().score
    assert score == 1000 * 8 * 10**12 * n // (9 * 10**12) ** 2


def test_phrases_of_nothing(empty, spark):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(documents(spark, [(1, "too few words"), (2, None)])).count() == 0
