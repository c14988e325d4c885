import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, rangecoder, tokencount, tokenfiles

WORDS, BYTES, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
PIECES = [" ", " ", "\n", "\t", "a", "Bc", "'s", "1", "é", "\xa0", "　", " ", "\x1c", "\x85", "!", "<|endoftext|>", "日本", "é", "'ll", "word", "ing"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_counts_are_the_library_s(spark):
    values = [*texts(1500, 1), None, "", "x" * 5000, "a" * 60 + " b", "Hello hello " * 3000]
    library = Tokenizer.from_file(WORDS)
    want = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) if t else (0, 0) for i, t in enumerate(values)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(frame(spark, values), WORDS).collect()}
    assert got == want
    assert tokencount.count_tokens(frame(spark, values).limit(0), WORDS).count() == 0


def test_bpe_is_the_library_s(spark):
    import tiktoken

    values = [*texts(400, 2), None, "", "a" * 9000, " " * 5000 + "x", "the cat " * 20000, "ab1" * 3000 + " é" * 40000]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe.digest(frame(spark, values), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(values):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_and_decode(spark):
    values = [*texts(50, 3), None]
    ids = bpe.encode(frame(spark, values), RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(values)}


def test_runs_are_encoded_like_whole_texts():
    encoder, library = tokenfiles.RunEncoder(BYTES), Tokenizer.from_file(BYTES)
    values = texts(20000, 4)
    got = encoder.encode([t.encode() for t in values])
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(values, add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("ids", [[], [0], [65535, 0, 1, 2], list(range(3000)), [7] * 5000])
def test_segments(ids):
    data = rangecoder.pack(9, [1, None], np.array([len(ids), 0]), np.array(ids, np.int64))
    before, docs, sizes, back = rangecoder.unpack(data)
    assert (before, docs, sizes.tolist(), back.tolist()) == (9, [1, None], [len(ids), 0], ids)
    with pytest.raises(ValueError):
        rangecoder.unpack(data[:-1] if ids else data + b"x")
    if len(ids) == 3000:
        broken = bytearray(data)
        broken[len(data) // 2] ^= 0x55
        with pytest.raises(ValueError):
            rangecoder.unpack(bytes(broken))


def test_random_segments():
    rng = np.random.default_rng(3)
    for n in (1023, 1024, 1025, 20000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 30, n), rng.integers(0, 65536, n))
        assert (rangecoder.unpack(rangecoder.pack(0, [], np.zeros(0), ids))[3] == ids).all()


def test_files(spark):
    values = [*texts(60, 5), None, "", "dup", "dup"]
    rng = random.Random(1)
    keys = [rng.randrange(1000) for _ in values]
    keys[3], keys[4] = None, keys[5]
    docs = spark.createDataFrame(list(zip(keys, values, strict=True)), "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    rows = sorted(zip(keys, values, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for key, text in rows:
        ids = [*(library.encode(text, add_special_tokens=False).ids if text else []), 0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = tokenfiles.read_ids(spark, tokenfiles.write_ids(docs, BYTES), with_ids=True).collect()
    assert sorted((r.start, r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.ids) for r in got) == sorted((s, k is None, k or 0, n, c, i) for k, s, n, c, i in want)
    assert tokenfiles.read_ids(spark, tokenfiles.write_ids(docs.limit(0), BYTES)).count() == 0


def test_files_of_named_documents(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", None), (None, "x")], "doc_id string, text string")
    got = tokenfiles.read_ids(spark, tokenfiles.write_ids(docs, BYTES)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "a", "b"] and [r.start for r in got] == [0, got[0].n_tokens, got[0].n_tokens + 1]


def test_words_are_encoded_once_and_ids_coded_in_one_step(monkeypatch):
    """The library gets a word once, whatever marks follow it, and the range coder narrows once an id."""
    encoder, library = tokenfiles.RunEncoder(BYTES), Tokenizer.from_file(BYTES)
    asked, plain = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: asked.extend(texts) or plain(texts))
    values = ["x word, word. word! word", "x word; word?!"]
    got = encoder.encode([t.encode() for t in values])
    assert sum(b"word" in w for w in b" ".join(asked).split()) == 1
    assert got == [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(values, add_special_tokens=False)]
    puts, put = [], rangecoder._Writer.put
    monkeypatch.setattr(rangecoder._Writer, "put", lambda *a: puts.append(1) or put(*a))
    assert rangecoder.encode_blocks(np.arange(500)) and len(puts) == 500


@pytest.mark.parametrize(("entries", "runs"), [(1_000_000, 2_000), (50, 3), (0, 3)])
def test_odd_marks_and_blanks(monkeypatch, entries, runs):
    monkeypatch.setattr(tokenfiles, "CACHE_ENTRIES", entries)
    monkeypatch.setattr(tokenfiles, "RUNS_A_TEXT", runs)
    encoder, library, rnd = tokenfiles.RunEncoder(BYTES), Tokenizer.from_file(BYTES), random.Random(5)
    parts = ["a", "the", "\u00e9", "\u00df", "\u2026", "\u00bb", ".", ",", "!", "'", "'s", "n't", "1", "\u0663", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "<|endoftext|>", "_", "\U0001f600", "\u0301", "\u00b2", "\u2167", "\u6f22", "\x00", "\u200b"]
    for _ in range(3):
        values = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(700)]
        want = [[*e.ids, 7] for e in library.encode_batch(values, add_special_tokens=False)]
        ids, sizes = encoder.encode_all(pa.array([t.encode() for t in values]), 7)
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


def test_lines_and_letters_end_words(monkeypatch):
    """A word goes to the library apart from the line after it and from marks after a letter with an accent, and only once."""
    encoder, library = tokenfiles.RunEncoder(BYTES), Tokenizer.from_file(BYTES)
    asked, plain = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts: asked.extend(texts) or plain(texts))
    values = ["x word caf\u00e9.\nThen word caf\u00e9", "x word.\nThen caf\u00e9!\nThen", "\u65e5\u672c\n\u65e5 word\n\n\nThen\n"]
    got = encoder.encode([t.encode() for t in values])
    assert got == [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(values, add_special_tokens=False)]
    joined = b"".join(asked)
    assert [joined.count(w) for w in (b" word", " caf\u00e9".encode(), b"\nThen", b"\n\n\nThen")] == [1, 1, 2, 1]


@pytest.mark.parametrize("collide", [False, True])
def test_runs_are_told_apart(monkeypatch, collide):
    """Runs with equal beginnings, zero bytes at the end or one place in the table keep numbers of their own."""
    if collide:
        monkeypatch.setattr(tokenfiles._Keys, "_first", lambda self, keys: np.full(len(keys), len(self.table) - 2))
    rnd = random.Random(7)
    runs = list(dict.fromkeys([b"", b"a", b"a\0", b"a\0\0", b"\0", *(bytes(rnd.choices(b"\0ab\x1f", k=rnd.randint(0, 40))) for _ in range(300)), b"x" * 31, b"x" * 32]))
    keys, short = tokenfiles._keys(pa.array(runs, pa.binary())[3:])
    runs = runs[3:]
    assert short.tolist() == [len(r) <= 31 for r in runs]
    keys = keys[short]
    table = tokenfiles._Keys(len(keys))
    table.add(keys[:50])
    table.add(keys[50:-9])
    assert table.find(keys).tolist() == [*range(len(keys) - 9), *[-1] * 9]


def test_parts_of_arrays_and_empty_texts():
    encoder, library = tokenfiles.RunEncoder(BYTES), Tokenizer.from_file(BYTES)
    values = ["left out", "", "a  \n b", "", "the end.", "<|endoftext|>", "", "left out"]
    some = pa.array([t.encode() for t in values], pa.binary())[1:-1]
    want = [library.encode(t, add_special_tokens=False).ids for t in values[1:-1]]
    for end in (None, 0):
        ids, sizes = encoder.encode_all(some, end)
        whole = [w + [0] * (end is not None) for w in want]
        assert ids.tolist() == [x for w in whole for x in w] and sizes.tolist() == [len(w) for w in whole]
    ids, sizes = encoder.encode_all(pa.array([b"", b""], pa.binary()))
    assert len(ids) == 0 and sizes.tolist() == [0, 0]
    ids, sizes = encoder.encode_all(pa.array([b"", b""], pa.binary()), 9)
    assert ids.tolist() == [9, 9] and sizes.tolist() == [1, 1]


def test_carries_and_low_bits_of_many_blocks():
    """More blocks than are put together at once; long runs of one id, then literals only, force carries."""
    rng = np.random.default_rng(8)
    ids = np.where(rng.random(150_000) < 0.02, rng.integers(0, 65536, 150_000), 7)
    ids[70_000:80_000] = rng.integers(32768, 65536, 10_000)
    parts = rangecoder.encode_blocks(ids)
    assert len(parts) > 2 * 64 and (rangecoder.decode_blocks(parts, len(ids)) == ids).all()
