"""Repeated passages by a distributed difference-cover suffix sort, cut off at the passage length.

What has to be known of two suffixes is whether their first LENGTH bytes agree. The work
goes as in difference-cover sorting:

1. Suffixes at the positions of a difference cover are sampled, in every document alike. For
   any two positions there is a shift below PERIOD that takes both onto the cover, so suffixes
   agreeing in LENGTH bytes have sampled suffixes within reach that agree in REST bytes.
2. Names come from triples: three neighbouring names of a level give the name of a piece three
   times as long (1, 3, 9, 27, 81 bytes). A name is a fingerprint of the piece instead of its
   rank, so the recursion needs no sort of its own.
3. The sampled names are sorted over the cluster; unique ones have no partner and are dropped.
4. The remaining suffixes - those that reach a kept sample - are merged in by the name of their
   first LENGTH bytes, sorted again, and equal neighbours are the repeated passages.

Names travel as sorted arrays, one for each block of documents and range of names. A name that
a block holds many times is sent once with a mark, so the copies of a hot passage don't meet
in one place. What comes back is a bit a name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import narrow_batches, shared_dir

#: Bytes that have to be repeated.
LENGTH = 200
#: A perfect difference cover: every residue is a difference of two of these positions.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
#: Bytes in which the sampled suffixes within reach of two equal passages agree.
REST = LENGTH - PERIOD + 1
#: Bytes of text in a block; a longer document is a block by itself and decides a task's memory (about 40 times its bytes).
BLOCK_BYTES = 4 << 20
#: Bytes of names that meet in one task of the name sort.
RANGE_BYTES = 24 << 20

_A, _B, _C, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BYTES = np.random.Generator(np.random.PCG64(91)).integers(1, 2**63, (3, 256), dtype=np.uint64)
_PIECE = 1 << 17
_NAMES = "part int, block long, kind int, names binary, marks binary"
_BITS = "block long, part int, kind int, twice binary, first binary"


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _M
    x ^= x >> np.uint64(29)
    return x


def _triples(names: np.ndarray, step: int) -> np.ndarray:
    """The names of pieces of 3 * step bytes from those of step bytes."""
    n = len(names) - 2 * step
    x = names[:n] * _A
    x += names[step : step + n] * _B
    x += names[2 * step :] * _C
    return _stir(x)


def names81(data: np.ndarray) -> np.ndarray:
    """For each position the name of the 81 bytes from there; the last 80 positions have none."""
    n = max(0, len(data) - 80)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _PIECE):
        d = data[at : min(at + _PIECE, n) + 80]
        x = _BYTES[0][d[:-2]]
        x += _BYTES[1][d[1:-1]]
        x += _BYTES[2][d[2:]]
        x = _stir(x)
        for step in (3, 9, 27):
            x = _triples(x, step)
        out[at : at + len(x)] = x
    return out


def _rest_names(n81: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _stir(n81[at] * _A + n81[at + REST - 81] * _B)


def _passage_names(n81: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of the LENGTH bytes from each position."""
    x, y, z = n81[at], n81[at + 81], n81[at + LENGTH - 81]
    return _stir(x * _A + y * _B + z * _C), _stir(x * _C + y * _A + z * _M)


class Block:
    """Documents of a block in one array, with what the phases compute from it."""

    def __init__(self, lens: list[int], data: bytes, parts: int):
        self.data = np.frombuffer(data, np.uint8)
        self.lens = np.array(lens, np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.bits = parts.bit_length() - 1
        self.raw = data
        self.parts = parts

    def document_names(self) -> tuple[np.ndarray, np.ndarray]:
        """The long enough documents and a 64-bit name of each."""
        docs = np.flatnonzero(self.lens >= LENGTH)
        view = memoryview(self.raw)
        names = [int.from_bytes(hashlib.blake2b(view[s:e], digest_size=8).digest(), "little") for s, e in zip(self.starts[docs].tolist(), self.ends[docs].tolist(), strict=True)]
        return docs, np.array(names, np.uint64)

    def sample(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions of the given documents and the keys of their names: range and 32 more bits."""
        longest = int(self.lens[docs].max()) if len(docs) else 0
        cover = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + np.array(COVER)).reshape(-1)
        last = np.searchsorted(cover, self.lens[docs] - REST, "right")
        at = np.concatenate([np.zeros(0, np.int64), *(cover[:k] + s for k, s in zip(last.tolist(), self.starts[docs].tolist(), strict=True))])
        return at, _rest_names(self.n81, at) >> np.uint64(32 - self.bits)

    @property
    def n81(self) -> np.ndarray:
        if not hasattr(self, "_n81"):
            self._n81 = names81(self.data)
        return self._n81

    def reached(self, samples: np.ndarray) -> np.ndarray:
        """Positions of passages that have one of the samples within reach."""
        doc = np.searchsorted(self.ends, samples, "right")
        low = np.maximum(self.starts[doc], samples - (PERIOD - 1))
        high = np.minimum(samples, self.ends[doc] - LENGTH)
        fits = low <= high
        step = np.bincount(low[fits], minlength=len(self.data) + 1) - np.bincount(high[fits] + 1, minlength=len(self.data) + 1)
        return np.flatnonzero(np.cumsum(step[:-1]))


def _packed(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each occurs more than once, and the index of each input's key."""
    values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return values, counts > 1, inverse


def _rows(block: int, kind: int, parts: np.ndarray, names: np.ndarray, marks: np.ndarray) -> pa.RecordBatch | None:
    """One row for each range of names (parts is ascending)."""
    if not len(parts):
        return None
    edge = np.flatnonzero(np.diff(parts)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(parts)]])
    columns = [
        pa.array(parts[begin].astype(np.int32)),
        pa.array(np.full(len(begin), block), pa.int64()),
        pa.array(np.full(len(begin), kind), pa.int32()),
        pa.array([names[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
        pa.array([np.packbits(marks[a:b]).tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
    ]
    return pa.record_batch(columns, names=["part", "block", "kind", "names", "marks"])


#: Kinds of names: whole documents, samples (32 bits), passages.
DOCUMENT, SAMPLED, PASSAGE = 0, 1, 2


def _compare(table: pa.Table) -> pa.Table:
    """All names of a range: which occur in more than one place, and in which block first."""
    out = []
    kinds = table["kind"].to_numpy()
    for kind in np.unique(kinds):
        rows = table.filter(pa.array(kinds == kind)).sort_by("block")
        blobs = [np.frombuffer(b.as_buffer(), np.uint32 if kind == SAMPLED else np.uint64) for b in rows["names"]]
        sizes = np.array([len(b) for b in blobs])
        names = np.concatenate(blobs)
        marks = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=n) for m, n in zip(rows["marks"], sizes.tolist(), strict=True)]).astype(bool)
        order = np.argsort(names, kind="stable")
        ordered = names[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        run = np.cumsum(new) - 1
        many = (np.bincount(run) > 1) | (np.bincount(run, marks[order]) > 0)
        twice, first = np.empty(len(names), bool), np.empty(len(names), bool)
        twice[order], first[order] = many[run], new
        ends = np.cumsum(sizes)
        pack = lambda flags: pa.array([np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())  # noqa: E731,B023
        out.append(pa.table({"block": rows["block"], "part": rows["part"], "kind": rows["kind"], "twice": pack(twice), "first": pack(first)}))
    return pa.concat_tables(out)


def _answers(found: list[dict] | None, kind: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits twice and first of the block's names of a kind, in their order."""
    flags = np.zeros((2, len(parts)), bool)
    for row in found or []:
        if row["kind"] == kind:
            a, b = np.searchsorted(parts, [row["part"], row["part"] + 1])
            for i, name in enumerate(("twice", "first")):
                flags[i, a:b] = np.unpackbits(np.frombuffer(row[name], np.uint8), count=b - a)
    return flags[0], flags[1]


def _first_names(block: Block):
    """Phase 1: document names and, of the documents that aren't copies of one in the block, sampled names."""
    docs, names = block.document_names()
    shift = np.uint64(64 - block.bits)
    values, first_at, inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    own = docs[np.sort(first_at)]
    at, keys = block.sample(own)
    samples, several, which = _packed(keys, 32)
    return (docs, (values >> shift) if block.bits else np.zeros(len(values), np.uint64), values, counts > 1, inverse, first_at), (at, samples >> np.uint64(32), samples, several, which)


def _passages(block: Block, found: list[dict] | None):
    """Phase 2: names of the passages within reach of repeated samples; copies of a document elsewhere are left out."""
    (docs, parts, _, _, inverse, first_at), (at, s_parts, _, _, which) = _first_names(block)
    twice, first = _answers(found, DOCUMENT, parts)
    copied = docs[twice[inverse]]
    stands = docs[np.sort(first_at[first | ~twice])]  # one document of each text in all blocks
    repeated, _ = _answers(found, SAMPLED, s_parts)
    kept = at[repeated[which]]
    kept = kept[np.isin(np.searchsorted(block.ends, kept, "right"), stands)]
    places = block.reached(kept)
    one, two = _passage_names(block.n81, places)
    values, first_at, inverse, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    bits = np.uint64(block.bits)
    p = (values >> (np.uint64(64) - bits)) if block.bits else np.zeros(len(values), np.uint64)
    sent = (values << bits) | (two[first_at] & ((np.uint64(1) << bits) - np.uint64(1)))
    return copied, places, p, sent, counts > 1, inverse


def _covered(block: Block, found: list[dict] | None) -> np.ndarray:
    """Phase 3: the bytes of the block that lie in a repeated passage."""
    copied, places, parts, _, _, inverse = _passages(block, found)
    twice, _ = _answers(found, PASSAGE, parts)
    begin = places[twice[inverse]]
    step = np.zeros(len(block.data) + 1, np.int64)
    step += np.bincount(begin, minlength=len(step))
    step -= np.bincount(begin + LENGTH, minlength=len(step))[: len(step)]
    step += np.bincount(block.starts[copied], minlength=len(step)) - np.bincount(block.ends[copied], minlength=len(step))
    return np.cumsum(step[:-1]) > 0


def _blocks_schema(source: DataFrame) -> T.StructType:
    """One row a block: the columns of source as arrays, the texts as lengths and one binary value."""
    long = T.LongType()
    arrays = [T.StructField({"id": "ids"}.get(f.name, f.name), T.ArrayType(f.dataType)) for f in source.schema.fields if f.name != "text"]
    return T.StructType([T.StructField("block", long), T.StructField("lens", T.ArrayType(long)), T.StructField("data", T.BinaryType()), *arrays])


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    texts: list[bytes] = []
    pieces: list[list[pa.Array]] = []
    held = 0

    def flush(names: list[str]) -> pa.RecordBatch:
        nonlocal texts, pieces, held, number
        whole = [pa.concat_arrays([p[c] for p in pieces]) for c in range(len(names))]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
        lens = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
        columns = [pa.array([number], pa.int64()), lens, pa.array([b"".join(texts)], pa.binary()), *arrays]
        texts, pieces, held, number = [], [], 0, number + 1
        return pa.record_batch(columns, names=["block", "lens", "data", *names])

    names: list[str] = []
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        names = [{"id": "ids"}.get(c, c) for c in others]
        begin = 0

        def take(end: int) -> None:
            nonlocal begin
            if end > begin:
                pieces.append([batch.column(c).slice(begin, end - begin) for c in others])  # noqa: B023
            begin = end

        for i, t in enumerate(batch.column("text").to_pylist()):
            t = t or b""
            if texts and held + len(t) > BLOCK_BYTES:
                take(i)
                yield flush(names)
            texts.append(t)
            held += len(t)
        take(batch.num_rows)
    if texts:
        yield flush(names)


def _blocks_of(batch: pa.RecordBatch, parts: int):
    for row in range(batch.num_rows):
        get = lambda c: batch.column(c)[row]  # noqa: E731,B023
        rows = {c: get(c).values for c in ("ids", "carried") if c in batch.schema.names}
        yield get("block").as_py(), rows, Block(get("lens").as_py(), get("data").as_py(), parts), (get("found").as_py() if "found" in batch.schema.names else None)


def _mapped(blocks: DataFrame, parts: int, f, schema: T.StructType | str) -> DataFrame:
    """f(block number, arrays of ids and carried rows, Block, answers) -> record batches, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows, block, found in _blocks_of(batch, parts):
                for out in f(number, rows, block, found):
                    if out is not None:
                        yield out

    return blocks.mapInArrow(run, schema)


def _sorted_names(rows: DataFrame) -> DataFrame:
    """The name sort: ranges of names are brought together and compared."""
    from quern.llm.common import written

    return written(rows.groupBy("part").applyInArrow(_compare, _BITS), "name-bits")


def _with_answers(blocks: DataFrame, *bits: DataFrame) -> DataFrame:
    """Each block with the bits of its names. The blocks stay where they are: their table is bucketed by number."""
    rows = bits[0]
    for more in bits[1:]:
        rows = rows.union(more)
    found = rows.groupBy("block").agg(F.collect_list(F.struct("part", "kind", "twice", "first")).alias("found"))
    return blocks.join(found.hint("shuffle_hash"), "block", "left")


def _phases(source: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of the rows (id, text, perhaps carried) with all answers, and the number of ranges."""
    spark = source.sparkSession
    narrow_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quern_blocks_{uuid.uuid4().hex}"
    made = source.mapInArrow(_make_blocks, _blocks_schema(source))
    made.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    blocks = spark.table(name)  # holds its files from here on, so the catalogue needn't keep the name
    spark.sql(f"DROP TABLE {name}")
    size = blocks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = 1 << max(0, max(n - 1, size * 4 * len(COVER) // PERIOD // RANGE_BYTES).bit_length())

    def first(number, rows, block, found):
        (_, p, values, many, _, _), (_, sp, samples, several, _) = _first_names(block)
        yield _rows(number, DOCUMENT, p, values, many)
        yield _rows(number, SAMPLED, sp, (samples & np.uint64(0xFFFFFFFF)).astype(np.uint32), several)

    def second(number, rows, block, found):
        _, _, p, sent, many, _ = _passages(block, found)
        yield _rows(number, PASSAGE, p, sent, many)

    one = _sorted_names(_mapped(blocks, parts, first, _NAMES))
    two = _sorted_names(_mapped(_with_answers(blocks, one), parts, second, _NAMES))
    return _with_answers(blocks, one, two), parts


def _document_rows(block: Block, covered: np.ndarray, with_text: bool) -> list[pa.Array]:
    keep = ~covered
    kept = block.data[keep].tobytes()
    counts = np.concatenate([[0], np.cumsum(keep)])
    begin, end = counts[block.starts], counts[block.ends]
    edge = covered & np.concatenate([[True], ~covered[:-1]])
    edge[block.starts[block.lens > 0]] = covered[block.starts[block.lens > 0]]
    spans = np.concatenate([[0], np.cumsum(edge)])
    view = memoryview(kept)
    pieces = [view[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    columns = [pa.array(block.lens), pa.array(block.lens - (end - begin)), pa.array(spans[block.ends] - spans[block.starts]), pa.array([hashlib.sha256(p).hexdigest() for p in pieces])]
    return columns + ([pa.array([bytes(p).decode("utf-8", "ignore") for p in pieces])] if with_text else [])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that lies in a LENGTH-byte string starting at two places of the corpus, in one
    document or two, is removed everywhere; strings are judged on the input. A null text
    counts as empty; equal rows are documents of their own.

    Ids of whole numbers come back as long, others as they are.

    with_text adds text, what is left, and the other columns of docs, values of any type
    unchanged; columns of the results' names give way. There a null text stays null, and a
    character of which a part is removed goes as a whole.
    """
    results = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    carry = [c for c in docs.columns if c not in (doc_id, text, *results)] if with_text else []
    id_type = docs.schema[doc_id].dataType
    id_type = T.LongType() if isinstance(id_type, T.IntegralType) else id_type
    columns = [F.col(f"`{doc_id}`").cast(id_type).alias("id"), F.col(f"`{text}`").cast("binary").alias("text")]
    if with_text:
        columns.append(F.struct(F.col(f"`{text}`").isNull().alias("null_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried"))
    answered, parts = _phases(docs.select(*columns))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, long) for c in results[1:4]], T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("text", T.StringType()).add("carried", answered.schema["carried"].dataType.elementType)
    names = schema.names

    def last(number, rows, block, found):
        yield pa.record_batch([rows["ids"], *_document_rows(block, _covered(block, found), with_text), *([rows["carried"]] if with_text else [])], names=names)

    out = _mapped(answered, parts, last, schema)
    if not with_text:
        return out
    return out.withColumn("text", F.when(~F.col("carried.null_text"), F.col("text"))).select(*results, *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])
