"""Token ids of a corpus in compressed files, in ascending document order, and back."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import narrow_batches, shared_dir

#: Ids of a segment, unless one document alone has more.
SEGMENT_IDS = 8_000_000
#: Runs that a worker keeps encoded, and the longest run kept (a key has room for so many bytes).
CACHE_ENTRIES, CACHE_BYTES = 2_000_000, 31
#: Bytes of text that are looked up at once, and unknown runs that the library gets as one text.
LOOKUP_BYTES, RUNS_A_TEXT = 16 << 20, 2_000
#: Kinds of bytes: 1 blank, 2 marks, 3 letters and digits, 4 what ends a letter from U+00C0 to U+00FF after the byte C3, 5 line feed.
_KINDS = bytes(
    1 if c == 0x20 else 2 if c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 3 if c < 0x80 and chr(c).isalnum() else 4 if 0x80 <= c < 0xC0 and c not in b"\x97\xb7" else 5 if c == 0x0A else 0
    for c in range(256)
)
#: Shards whose totals are broadcast: one number for each partition of the shuffle.
MAX_SHARDS = 100_000

_COLUMNS = (("shard", T.IntegerType()), ("segment", T.IntegerType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()), ("data", T.BinaryType()))


class RunEncoder:
    """ids of texts by a byte-level tokenizer file, run by run.

    A text is cut before each blank, each mark that follows a letter or digit and each line feed
    that follows one of the three. The pre-tokenizer starts a token there too, before a blank
    unless other white space stands on both sides: texts with such blanks, or with a special
    string, go to the library whole. Arrow numbers the different runs of many texts, the library
    encodes those that are new, joined again (a token that starts with a blank or line feed starts
    a run), and the ids are put together by number.
    """

    UNSAFE = r"[\t-\r \x80-\xbf] (?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80|\z)"
    #: Runs that can't be joined: they start with neither blank nor line feed, or with more that may be white space, or have another line feed.
    APART = re.compile(rb"\Z|[^ \n]|.(?:\Z|[\t-\r \x80-\xbf]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80|[^\n]*\n)", re.DOTALL)
    _shared: dict[str, RunEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65535 don't fit the file format")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.starts = np.zeros(1 << 16, bool)
        self.starts[[i for token, i in self.library.get_vocab().items() if token[:1] in ("\u0120", "\u010a")]] = True
        # known runs by number: their keys, and their ids as binary values
        self.known, self.ids = _Keys(CACHE_ENTRIES), pa.array([], pa.binary())

    @classmethod
    def of_worker(cls, path: str) -> RunEncoder:
        """One for each worker process, kept between tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u2") for e in found]

    def runs(self, runs: list[bytes]) -> pa.Array:
        """The ids of each run, as binary values."""
        apart = [bool(self.APART.match(r)) for r in runs]
        joined = [r for r, a in zip(runs, apart, strict=True) if not a]
        texts = [b"".join(joined[i : i + RUNS_A_TEXT]) for i in range(0, len(joined), RUNS_A_TEXT)]
        ids = np.concatenate([np.zeros(0, "<u2"), *self.whole(texts)])
        at = np.flatnonzero(self.starts[ids])
        if len(at) == len(joined) and not any(s in t for s in self.special for t in texts):
            found = _binaries(ids, np.append(at, len(ids)))
        else:
            found = _joined(self.whole(joined))
        alone = _joined(self.whole([r for r, a in zip(runs, apart, strict=True) if a]))
        order, apart = np.empty(len(runs), np.int64), np.array(apart, bool)
        order[~apart], order[apart] = np.arange(len(joined)), np.arange(len(joined), len(runs))
        return pa.concat_arrays([found, alone]).take(pa.array(order))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as 16-bit integers."""
        ids, sizes = self.encode_all(pa.array(texts, pa.binary()))
        ends = np.cumsum(sizes).tolist()
        return [ids[e - k : e].tobytes() for e, k in zip(ends, sizes.tolist(), strict=True)]

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array of 16-bit integers, each text's followed by end if there is one, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        unsafe = pc.match_substring_regex(texts, self.UNSAFE)
        for s in self.special:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, s))
        apart = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        own = self.whole(texts.take(pa.array(apart)).to_pylist())
        if len(apart):
            texts = pc.if_else(unsafe, pa.scalar(b"", pa.binary()), texts)
        pieces, first = _cut(texts)
        coded = pieces.dictionary_encode()
        number, pool = self._different(coded.dictionary)
        # unsafe texts and the end id are binary values behind those of the runs
        places, n = number.take(coded.indices.to_numpy()), len(pool)
        pool = pa.concat_arrays([pool, _joined([*own, *([] if end is None else [np.array([end], "<u2")])])])
        more, at = np.arange(n, n + len(apart), dtype=np.int32), apart
        if end is not None:
            more, at = np.concatenate([more, np.full(len(texts), len(pool) - 1, np.int32)]), np.concatenate([at, np.arange(len(texts))])
        order = np.argsort(at, kind="stable")
        out = pool.take(pa.array(np.insert(places, first[1:].take(at.take(order)), more.take(order))))
        ends = first + np.append(0, np.cumsum(np.bincount(at, minlength=len(texts))))
        offsets = _offsets(out).take(ends)
        return np.frombuffer(out.buffers()[2] or b"", "<u2")[: offsets[-1] // 2], np.diff(offsets).astype(np.int64) // 2

    def _different(self, runs: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each of different runs, and the binary values (ids) that are numbered."""
        keys, short = _keys(runs)
        number = self.known.find(keys)
        number[~short] = -1
        unknown = np.flatnonzero(number < 0)
        fresh = self.runs(runs.take(pa.array(unknown)).to_pylist())
        # those that are kept come first; the ones that a worker meets first are the frequent ones
        took = short.take(unknown)
        took &= np.cumsum(took) <= self.known.room - self.known.n
        order = np.concatenate([np.flatnonzero(took), np.flatnonzero(~took)])
        number[unknown.take(order)] = np.arange(len(self.ids), len(self.ids) + len(order))
        pool = pa.concat_arrays([self.ids, fresh.take(pa.array(order))])
        if took.any():
            self.known.add(keys[unknown[took]])
            self.ids = pool[: len(self.ids) + int(took.sum())]
        return number, pool


class _Keys:
    """Numbers of different keys (rows of four 64-bit integers) in the order of arrival, found by open addressing."""

    def __init__(self, room: int):
        self.room, self.bits = room, max(room, 8).bit_length() + 1  # less than half full
        self.table, self.keys, self.n = np.full(1 << self.bits, -1, np.int32), np.zeros((1024, 4), np.uint64), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys @ np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for others."""
        found, at, left = np.full(len(keys), -1, np.int32), self._first(keys), np.arange(len(keys))
        while len(left):
            number = self.table.take(at)
            taken = np.flatnonzero(number >= 0)
            left, at, number = left.take(taken), at.take(taken), number.take(taken)
            same = (self.keys.take(number, axis=0) == keys.take(left, axis=0)).all(1)
            found[left[same]] = number[same]
            left, at = left[~same], at[~same] + 1 & len(self.table) - 1
        return found

    def add(self, keys: np.ndarray) -> None:
        """Number keys that differ from each other and from all before."""
        number, at = np.arange(self.n, self.n + len(keys), dtype=np.int32), self._first(keys)
        if self.n + len(keys) > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros((max(len(self.keys), len(keys)), 4), np.uint64)])
        self.keys[self.n : self.n + len(keys)] = keys
        self.n += len(keys)
        while len(number):
            free = np.flatnonzero(self.table.take(at) < 0)
            self.table[at.take(free)] = number.take(free)
            left = np.flatnonzero(self.table.take(at) != number)
            number, at = number.take(left), at.take(left) + 1 & len(self.table) - 1


def _keys(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A key for each run, which tells all runs of at most CACHE_BYTES (31) apart, and whether it has at most so many: its bytes, then its length."""
    offsets = _offsets(runs)
    data = np.frombuffer(b"".join([runs.buffers()[2] or b"", bytes(32)]), np.uint8)
    sizes = np.diff(offsets)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    keys, masks = np.zeros((len(sizes), 4), np.uint64), np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    for k in range(4):
        some = np.flatnonzero(sizes > 8 * k)
        keys[some, k] = words[offsets.take(some) + 8 * k] & masks.take(np.minimum(sizes.take(some) - 8 * k, 8))
    short = sizes <= CACHE_BYTES
    keys[:, 3] |= np.where(short, sizes, 0).astype(np.uint64) << np.uint64(56)
    return keys, short


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of all texts, and each text's first run, with the number of all runs at the end."""
    offsets = _offsets(texts)
    start, stop = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start:stop]
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    cut = kinds == 1
    # what stands before a mark or line feed: an ASCII letter or digit, a letter from U+00C0 to U+00FF, before a line feed also a mark
    at = np.flatnonzero((kinds[1:] == 2) | (kinds[1:] == 5)) + 1
    before, lead = kinds.take(at - 1), data.take(np.maximum(at - 2, 0))
    cut[at[(before == 3) | (before == 4) & (lead == 0xC3) | (before == 2) & (kinds.take(at) == 5)]] = True
    heads = offsets[:-1][np.diff(offsets) > 0] - start
    cut[heads] = True
    cuts = np.flatnonzero(cut).astype(np.int32)
    ends = pa.py_buffer(np.append(cuts, np.int32(stop - start)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(data)]), np.searchsorted(cuts, offsets - start)


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1] or bytes(4), np.int32)[values.offset : values.offset + len(values) + 1]


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of ids between neighbouring ends as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])


def _joined(parts: list[np.ndarray]) -> pa.Array:
    return _binaries(np.concatenate([np.zeros(0, "<u2"), *parts]), np.cumsum([0, *map(len, parts)]))


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together until their texts (second column) have LOOKUP_BYTES: the more texts at once, the fewer runs come again."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= LOOKUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> str:
    """Encode every whole text, append end_id to each document and write the ids; the folder is returned.

    Documents are dealt over shards by ranges of ids and put in ascending order (null first,
    equal ids by text). A row of the table holds one segment of a shard in the format of
    rangecoder; Spark writes it, so any file system will do and a lost task leaves nothing.
    A null text counts as empty. Ids of whole numbers stand in the segment; for ids of another
    type it numbers its documents and the column names beside it holds their ids.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[doc_id].dataType
    whole = isinstance(kind, T.IntegralType)
    kind = T.LongType() if whole else kind
    ordered = docs.select(F.col(f"`{doc_id}`").cast(kind).alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    ordered = ordered.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    schema = T.StructType([T.StructField(c, t) for c, t in (*_COLUMNS, *([] if whole else [("names", T.ArrayType(kind))]))])

    def segments(batches):
        from pyspark import TaskContext

        from quern.llm.rangecoder import pack

        encoder, shard = RunEncoder.of_worker(tokenizer), TaskContext.get().partitionId()
        ids, names, before, number, id_type = [], [], 0, 0, None

        def flush():
            nonlocal before, number
            values = np.concatenate(ids)
            data = pack(before, names if whole else list(range(len(names))), np.array([len(x) for x in ids]), values)
            columns = [pa.array([v], t) for v, t in ((shard, pa.int32()), (number, pa.int32()), (len(names), pa.int64()), (len(values), pa.int64()), (data, pa.binary()))]
            if not whole:
                columns.append(pa.array([names], pa.list_(id_type)))
            row = pa.record_batch(columns, names=schema.names)
            before, number = before + len(values), number + 1
            ids.clear()
            names.clear()
            return row

        held = 0
        for batch in _grouped(batches):
            id_type = batch.column(0).type
            found, sizes = encoder.encode_all(batch.column(1), end_id)
            ends = np.cumsum(sizes).tolist()
            for name, size, to in zip(batch.column(0).to_pylist(), sizes.tolist(), ends, strict=True):
                if ids and held + size - 1 > SEGMENT_IDS:
                    yield flush()
                    held = 0
                ids.append(found[to - size : to])
                names.append(name)
                held += size
        if ids:
            yield flush()

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    ordered.mapInArrow(segments, schema).write.option("compression", "none").parquet(path)
    return path


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder of write_ids: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and ids if asked for.

    Every block's checksum is verified; damage raises an error.
    """
    table = spark.read.parquet(path)
    totals = sorted((r[0], r[1]) for r in table.groupBy("shard").agg(F.sum("n_ids")).limit(MAX_SHARDS + 1).collect())
    if len(totals) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    starts, n = [], 0
    for shard, ids in totals:
        starts.append((shard, n))
        n += ids
    offsets = spark.createDataFrame(starts, "shard int, offset long")
    names = ["doc_id", "shard", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    named = ["names"] if "names" in table.columns else []
    kind = table.schema["names"].dataType.elementType.simpleString() if named else "long"
    schema = f"doc_id {kind}, shard int, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches):
        from quern.llm.rangecoder import unpack

        for batch in batches:
            for row, (shard, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                before, doc_ids, sizes, ids = unpack(data.as_py())
                keys = batch.column(2)[row].values if named else pa.array(doc_ids, pa.int64())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [keys, pa.array([shard] * len(doc_ids), pa.int32()), pa.array(before + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.record_batch(columns, names=names)

    out = table.select("shard", "data", *named).mapInArrow(documents, schema).join(F.broadcast(offsets), "shard")
    return out.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
