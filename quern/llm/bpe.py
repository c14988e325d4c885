"""Byte-level BPE by the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fields, narrow_batches, per_text

#: Texts above so many characters are split at safe boundaries before they are encoded.
SPLIT_CHARS = 1 << 16
#: Matches above so many bytes are merged with a heap, whose cost doesn't grow with the square.
LONG_MATCH = 1 << 11

_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one very long match: lowest rank first, leftmost among equals."""
    n = len(piece)
    start, after, before, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = [i + 1 for i in range(n)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or ranks.get(piece[start[i] : stop]) != r:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (x, i, end[after[i]]))
        if before[i] >= 0 and (x := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (x, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """encode() and decode() of the rank file; the pattern splits a text, each match is merged separately."""

    #: A blank between two characters that aren't white space: a match of the pattern can start there
    #: and none can reach over it.
    SAFE = re.compile(r"(?<=\S) (?=\S)")
    LONG = re.compile(r"\S{%d}" % LONG_MATCH)

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def parts(self, text: str):
        """The text cut before blanks about every SPLIT_CHARS characters."""
        at = 0
        while len(text) - at > SPLIT_CHARS:
            m = self.SAFE.search(text, at + SPLIT_CHARS)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.parts(text) if len(text) > SPLIT_CHARS else (text,):
            if len(part) > LONG_MATCH and (self.LONG.search(part) or re.search(r"\s{%d}" % LONG_MATCH, part)):
                ids += self.encode_with_long(part)
            else:
                ids += self.library.encode_ordinary(part)
        return ids

    def encode_with_long(self, part: str) -> list[int]:
        """For parts with a very long run: each match by itself, long ones with the heap."""
        ids: list[int] = []
        for m in self.pattern.finditer(part):
            piece = m.group().encode("utf-8")
            if len(piece) > LONG_MATCH:
                ids += [self.ranks[piece]] if piece in self.ranks else merge_long(piece, self.ranks)
            else:
                ids += self.library.encode_ordinary(m.group())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: they need not be whole characters."""
        return self.library.decode_bytes(ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids: the token ids of every whole text, an empty list for a null or empty text.

    The rank file must be at path on every executor. A column ids that exists gives way.
    """
    narrow_batches(docs.sparkSession)

    def setup():
        encoder = Encoder(path, pattern)
        return lambda texts: [encoder.encode(t) if t else [] for t in texts]

    out = docs.withColumn("_ids", per_text(setup, pa.list_(pa.int32()), text, as_bytes=False))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "ids"], F.col("_ids").alias("ids"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded: the raw bytes of the ids (binary); null ids give empty bytes."""
    narrow_batches(tokens.sparkSession)

    def setup():
        encoder = Encoder(path, pattern)
        return lambda rows: [encoder.decode(x) if x else b"" for x in rows]

    out = tokens.withColumn("_decoded", per_text(setup, pa.binary(), F.col(ids).cast("array<int>"), as_bytes=False))
    return out.select(*[F.col(f"`{c}`") for c in tokens.columns if c != "decoded"], F.col("_decoded").alias("decoded"))


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (and ids if asked for) of encoding and decoding every whole text in one pass.

    ids_sha256 is over the decimal ids joined by one blank, decoded_sha256 over the decoded
    bytes; a null text counts as empty. Existing columns of these names give way.
    """
    narrow_batches(docs.sparkSession)

    def setup():
        encoder = Encoder(path, pattern)
        names = [str(i) for i in range(1 + max(encoder.ranks.values()))]

        def run(texts):
            out = []
            for t in texts:
                ids = encoder.encode(t) if t else []
                joined = " ".join(map(names.__getitem__, ids)).encode()
                out.append({"ids": ids, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(joined).hexdigest(), "decoded_sha256": hashlib.sha256(encoder.decode(ids)).hexdigest()})
            return out

        return run

    result = pa.struct([*_DIGEST, ("ids", pa.list_(pa.int32()))]) if with_ids else _DIGEST
    return fields(docs.withColumn("_bpe", per_text(setup, result, text, as_bytes=False)), "_bpe", [f.name for f in result])
