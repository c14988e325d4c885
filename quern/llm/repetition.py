"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import SLICE_BYTES, byte_slices, fields, narrow_batches, per_text

#: Largest share of a text's word characters inside duplicated n-grams, by words per n-gram.
DUPLICATE_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of a text's word characters inside lines equal to an earlier line.
DUPLICATE_LINE_LIMIT = 0.30
#: Largest share of symbols per word.
SYMBOL_LIMIT = 0.10
#: Words per window of n_repeat_words, its limit in percent, and the fewest words.
WINDOW, WINDOW_PERCENT, FEWEST_WORDS = 8, 30, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RESULT = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()), ("dup_ngram_share", pa.float64())])

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = np.uint64(pow(int(_K), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _K
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _K), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _rolling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of data[start:end] for each pair."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs more than once, and whether it occurs earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return twice, earlier


def measure(texts: list[bytes | None]) -> list[dict]:
    """The counts and the verdict for each text, all texts of the slice at once.

    Hashes of different texts are kept apart by mixing in the text's number, so one sort
    serves the whole slice.
    """
    blobs = [t or b"" for t in texts]
    # a line feed after each text ends its last word and its last line
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    sizes = np.array([len(b) + 1 for b in blobs])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n_texts = len(blobs)
    salt = _mix(np.arange(1, n_texts + 1, dtype=np.uint64) * _K)

    gap = _SEPARATOR[data]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and len(ends) and ends[0] < starts[0]:
        ends = ends[1:]
    text_of = np.searchsorted(offsets, starts, "right") - 1
    chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~gap)])
    word_chars = chars[ends] - chars[starts]
    per = lambda values, at=text_of: np.bincount(at, values, n_texts)
    n_words = np.bincount(text_of, minlength=n_texts)
    total_chars = per(word_chars)
    hashes = _rolling(data, starts, ends)

    # lines
    stops = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    line_chars = chars[stops] - chars[begins]
    line_text = np.searchsorted(offsets, begins, "right") - 1
    full = line_chars > 0
    begins, stops, line_chars, line_text = begins[full], stops[full], line_chars[full], line_text[full]
    _, earlier = _again(_rolling(data, begins, stops) ^ salt[line_text])
    dup_lines = per(earlier, line_text)
    dup_line_chars = per(line_chars * earlier, line_text)

    # n-grams of words
    worst = np.zeros(n_texts)
    over = np.zeros(n_texts, bool)
    repeat = np.zeros(n_texts, np.int64)
    share = lambda part: np.divide(part, total_chars, out=np.zeros(n_texts), where=total_chars > 0)
    for n in sorted({WINDOW, *DUPLICATE_LIMITS}):
        k = len(starts) - n + 1
        if k <= 0:
            continue
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h = h * _K + hashes[i : i + k]
        inside = text_of[:k] == text_of[n - 1 :]
        at = np.flatnonzero(inside)
        twice, _ = _again(_mix(h[at]) ^ salt[text_of[at]])
        step = np.zeros(len(starts) + 1, np.int32)
        hit = at[twice]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + n, -1)
        covered = np.cumsum(step[:-1]) > 0
        if n == WINDOW:
            repeat = per(covered).astype(np.int64)
        if n in DUPLICATE_LIMITS:
            part = share(per(word_chars * covered))
            worst = np.maximum(worst, part)
            over |= part > DUPLICATE_LIMITS[n]

    symbols = np.add.reduceat(_SYMBOL[data].astype(np.int64), offsets[:-1]) if n_texts else np.zeros(0, np.int64)
    lines = share(dup_line_chars)
    failed = (n_words < FEWEST_WORDS) | (100 * repeat > WINDOW_PERCENT * n_words)
    kept = ~failed & ~over & (lines <= DUPLICATE_LINE_LIMIT) & (symbols <= SYMBOL_LIMIT * n_words)
    columns = {"n_words": n_words, "word_chars": total_chars.astype(np.int64), "n_symbols": symbols, "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": repeat, "base_failed": failed, "kept": kept, "dup_line_share": lines, "dup_ngram_share": worst}
    values = [columns[c].tolist() for c in columns]
    return [dict(zip(columns, row, strict=True)) for row in zip(*values, strict=True)]


def measure_all(texts: list[bytes | None]) -> list[dict]:
    out: list[dict] = []
    for a, b in byte_slices(texts, SLICE_BYTES):
        out += measure(texts[a:b])
    return out


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repetition counts and the verdict kept of every whole text.

    Words are runs other than space and tab to carriage return. A null or empty text has no
    words, so it fails. Repeated rows stay; existing columns of the results' names give way.
    The largest text decides a task's memory: about 60 bytes for each of its bytes.
    """
    narrow_batches(docs.sparkSession)
    return fields(docs.withColumn("_quality", per_text(lambda: measure_all, _RESULT, text)), "_quality", [f.name for f in _RESULT])
