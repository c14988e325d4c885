"""Fill-in-middle transformation: cuts are found by a parallel scan with a finite automaton.

A text is a row of chunks of bytes. Each chunk is scanned by itself, from every state of the
automaton at once: it gives a function (state before -> state after, units started). Functions
compose associatively, so those of a text tell the state and the number of units before each of
its chunks, whichever task scanned it; only the chunk that holds a cut is scanned again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import narrow_batches, per_text, written

#: Bytes of a chunk; a longer text is scanned by several tasks.
CHUNK = 1 << 16
#: Bytes that the scan inside a task takes as one block; blocks advance side by side.
BLOCK = 512
#: Most chunk functions of long texts (about 100 bytes each) that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_CHUNKS = 100_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """table[state, byte] is the next state, with 128 added where a unit starts at that byte; state 0 is the first."""

    table: np.ndarray

    @property
    def states(self) -> int:
        return len(self.table)


def code_points() -> Automaton:
    """Units are code points of UTF-8; the state is the number of bytes that the present one still has.

    Bytes that aren't UTF-8 have a result too: a byte that continues nothing starts a unit.
    """
    lead = np.zeros(256, np.uint8)
    lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:0xF8] = 1, 2, 3
    table = np.tile(lead + np.uint8(128), (4, 1))
    for left in (1, 2, 3):
        table[left, 0x80:0xC0] = left - 1
    return Automaton(table)


def lines() -> Automaton:
    """Units are lines with their line feed; state 0 is the start of a line."""
    table = np.ones((2, 256), np.uint8)
    table[:, 10] = 0
    table[0] += 128
    return Automaton(table)


def words() -> Automaton:
    """Units are words with the white space behind them; white space before the first word belongs to that one."""
    table = np.ones((2, 256), np.uint8)
    table[:, [9, 10, 11, 12, 13, 32]] = 0
    table[0] += np.where(table[0] == 1, 128, 0).astype(np.uint8)
    return Automaton(table)


UNITS = {"code_points": code_points, "lines": lines, "words": words}


def _blocks(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the first block of each piece (and the end), and place and length of each block."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    many = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(many)])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], many)
    place = np.repeat(np.cumsum(sizes) - sizes, many) + inner * BLOCK
    return np.frombuffer(b"".join(pieces), np.uint8), first, place, np.minimum(BLOCK, np.repeat(sizes, many) - inner * BLOCK)


def _functions(a: Automaton, data: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block and state before it: the state after it and the units started, all blocks a byte at a time."""
    order = np.argsort(-length, kind="stable")
    at, ordered = place[order], -length[order]
    state = np.tile(np.arange(a.states, dtype=np.int64), (len(at), 1))
    count = np.zeros((len(at), a.states), np.int64)
    flat = a.table.ravel()
    for j in range(int(-ordered[0]) if len(at) else 0):
        m = np.searchsorted(ordered, -j)  # blocks longer than j bytes
        got = flat[(state[:m] << 8) + data[at[:m] + j][:, None]]
        count[:m] += got >> 7
        state[:m] = got & 127
    back = np.argsort(order, kind="stable")
    return state[back], count[back]


def _side_by_side(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For j = 0, 1, ...: the pieces that have a j-th block, and those blocks."""
    many = np.diff(first)
    order = np.argsort(-many, kind="stable")
    for j in range(int(many.max()) if len(many) else 0):
        live = order[: np.searchsorted(-many[order], -j)]
        yield live, first[:-1][live] + j


def summaries(pieces: list[bytes], a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The function of each piece: (pieces x states) states after it and units started; those of its blocks composed."""
    data, first, place, length = _blocks(pieces)
    after, started = _functions(a, data, place, length)
    state = np.tile(np.arange(a.states), (len(pieces), 1))
    count = np.zeros_like(state)
    for live, block in _side_by_side(first):
        count[live] += np.take_along_axis(started[block], state[live], 1)
        state[live] = np.take_along_axis(after[block], state[live], 1)
    return state, count


def locate(pieces: list[bytes], entry: np.ndarray, index: np.ndarray, a: Automaton) -> np.ndarray:
    """Place in each piece of its unit start number index (from 0), the piece being entered in state entry; -1 if there is none."""
    data, first, place, length = _blocks(pieces)
    after, started = _functions(a, data, place, length)
    state, seen, block_of, state_in, left = entry.copy(), np.zeros(len(pieces), np.int64), np.full(len(pieces), -1), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for live, block in _side_by_side(first):
        count = started[block, state[live]]
        hit = (seen[live] <= index[live]) & (index[live] < seen[live] + count)
        found = live[hit]
        block_of[found], state_in[found], left[found] = block[hit], state[found], index[found] - seen[found]
        seen[live] += count
        state[live] = after[block, state[live]]
    out = np.full(len(pieces), -1, np.int64)
    some = np.flatnonzero(block_of >= 0)
    at, size, s, wait = place[block_of[some]], length[block_of[some]], state_in[some], left[some]
    flat, done = a.table.ravel(), np.full(len(some), -1, np.int64)
    for j in range(int(size.max()) if len(some) else 0):
        live = np.flatnonzero((size > j) & (done < 0))
        got = flat[(s[live] << 8) + data[at[live] + j]]
        starts = got >= 128
        done[live[starts & (wait[live] == 0)]] = j
        wait[live] -= starts
        s[live] = got & 127
    out[some] = at + done - (np.cumsum([0, *map(len, pieces)])[:-1])[some]
    return out


_FUNCTION = pa.struct([("ends", pa.list_(pa.int8())), ("counts", pa.list_(pa.int64()))])


def _scan(column: Column, a: Automaton) -> Column:
    """The function of each chunk (binary)."""

    def setup():
        def run(chunks: list[bytes]) -> list[dict]:
            ends, counts = summaries(chunks, a)
            return [{"ends": e, "counts": c} for e, c in zip(ends.tolist(), counts.tolist())]

        return run

    return per_text(setup, _FUNCTION, column)


def _places(a: Automaton, *columns: Column) -> Column:
    """Byte places (first, second) of two unit starts within their chunks; columns: chunk, state, index of each, a null chunk for none."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for k in (0, 3):
                chunks, known = batch[k].to_pylist(), batch[k].is_valid().to_numpy(zero_copy_only=False)
                where = np.flatnonzero(known)
                states, index = (batch[k + i].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[where] for i in (1, 2))
                got = np.full(len(chunks), -1, np.int64)
                got[where] = locate([chunks[i] for i in where], states, index, a)
                out.append(pa.array(got, pa.int64()))
            yield pa.StructArray.from_arrays(out, ["first", "second"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "first long, second long")(*columns)


def _functions_of(texts: DataFrame, a: Automaton, chunk: int) -> DataFrame:
    """texts (_bytes, _key, ...) with _functions, the functions of the chunks in order.

    A text of one chunk is scanned where it is. Chunks of longer ones are dealt to all tasks; of
    equal texts each chunk's function is kept once.
    """
    spark = texts.sparkSession
    is_long = F.octet_length("_bytes") > chunk
    struct = lambda no, f: F.struct(no.cast("int").alias("no"), f["ends"].alias("ends"), f["counts"].alias("counts"))
    short = texts.where(~is_long).withColumn("_f", _scan(F.col("_bytes"), a)).withColumn("_functions", F.array(struct(F.lit(0), F.col("_f")))).drop("_f")
    long = texts.where(is_long).withColumn("_text_key", F.sha2("_bytes", 256))
    cut = long.select("_text_key", "_bytes", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("_bytes") - 1) / chunk).cast("int"))).alias("no"), "_key")
    cut = cut.select("_text_key", "no", "_key", F.substring(F.col("_bytes"), F.col("no") * chunk + 1, F.lit(chunk)).alias("_chunk"))
    scanned = cut.repartition("_text_key", "no", "_key").select("_text_key", "no", _scan(F.col("_chunk"), a).alias("_f"))
    each = scanned.groupBy("_text_key", "no").agg(F.first("_f").alias("_f"))
    plans = each.groupBy("_text_key").agg(F.sort_array(F.collect_list(struct(F.col("no"), F.col("_f")))).alias("_functions"))
    plans = written(plans, "fim-functions")
    small = (plans.agg(F.sum(F.size("_functions"))).first()[0] or 0) <= MAX_BROADCAST_CHUNKS
    found = long.join(F.broadcast(plans) if small else plans, "_text_key").select(*texts.columns, "_functions")
    return short.unionByName(found)


def cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, units: str = "code_points", chunk: int = CHUNK) -> DataFrame:
    """docs with n units, prefix_units, middle_units and cut_bytes (array of the two places in UTF-8 bytes), draws (h1 to h4), _bytes.

    The draws are the first four groups of eight digits of sha256("seed:doc_id") as unsigned numbers.
    """
    narrow_batches(docs.sparkSession, rows=2048)
    a = UNITS[units]()
    names = ["n", "prefix_units", "middle_units", "cut_bytes", "draws"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(*kept, digest.alias("_key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("_bytes"))
    draws = F.array(*[F.conv(F.substring("_key", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    d = _functions_of(rows, a, chunk).withColumn("draws", draws)
    # all functions composed from state 0: the number of units
    at = lambda values, state: F.get(values, state)
    total = F.aggregate("_functions", F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("n")), lambda x, f: F.struct(at(f["ends"], x["s"]).cast("int").alias("s"), (x["n"] + at(f["counts"], x["s"])).alias("n")), lambda x: x["n"])
    d = d.withColumn("n", total)
    d = d.withColumn("_a", F.least(*[F.col("draws")[i] % (F.col("n") + 1) for i in (0, 1)])).withColumn("_b", F.greatest(*[F.col("draws")[i] % (F.col("n") + 1) for i in (0, 1)]))
    # composed again with the cuts in hand: the chunk, entry state and start number of each cut
    none = F.struct(F.lit(None).cast("int").alias("no"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("long").alias("i"))

    def step(x: Column, f: Column) -> Column:
        count = at(f["counts"], x["s"])
        hit = lambda old, k: F.when((k > 0) & (x["n"] <= k) & (k < x["n"] + count), F.struct(f["no"].alias("no"), x["s"].alias("s"), (k - x["n"]).alias("i"))).otherwise(old)
        return F.struct(at(f["ends"], x["s"]).cast("int").alias("s"), (x["n"] + count).alias("n"), hit(x["a"], F.col("_a")).alias("a"), hit(x["b"], F.col("_b")).alias("b"))

    d = d.withColumn("_at", F.aggregate("_functions", F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("n"), none.alias("a"), none.alias("b")), step))
    piece = lambda c: F.when(F.col(f"_at.{c}.no").isNotNull(), F.substring(F.col("_bytes"), F.col(f"_at.{c}.no") * chunk + 1, F.lit(chunk)))
    d = d.withColumn("_found", _places(a, *[x for c in "ab" for x in (piece(c), F.col(f"_at.{c}.s").cast("long"), F.col(f"_at.{c}.i"))]))
    place = lambda c, field: F.when(F.col(f"_{c}") == 0, F.lit(0)).when(F.col(f"_{c}") == F.col("n"), F.octet_length("_bytes")).otherwise(F.col(f"_at.{c}.no") * chunk + F.col(f"_found.{field}")).cast("int")
    return d.select(*kept, "n", F.col("_a").alias("prefix_units"), (F.col("_b") - F.col("_a")).alias("middle_units"), F.array(place("a", "first"), place("b", "second")).alias("cut_bytes"), "draws", "_bytes")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, units: str = "code_points", chunk: int = CHUNK) -> DataFrame:
    """docs with n, form, prefix_units, middle_units and output, the transformed text.

    Of a hundred documents about rate are transformed, of those spm in a hundred with the suffix
    first. psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle; plain (the text as
    it is): an empty or null text, one that contains a mark, or one that isn't drawn; its
    prefix_units and middle_units are null. Each row is treated by itself, so repeated rows and
    ids give repeated results; a null id draws like an empty one. Columns of the results' names
    give way; an empty table gives none. Texts of any length: chunks of long ones are scanned by
    several tasks, the row itself stays where its text is read.
    """
    c = cuts(docs, doc_id, text, seed, units, chunk)
    kept = [F.col(f"`{x}`") for x in docs.columns if x not in ("n", "form", "prefix_units", "middle_units", "output")]
    whole = F.col("_bytes").cast("string")
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (F.col("draws")[2] % 100 >= rate), "plain").when(F.col("draws")[3] % 100 < spm, "spm").otherwise("psm")
    c = c.withColumn("form", form)
    piece = lambda start, end: F.substring(F.col("_bytes"), start + 1, end - start).cast("string")
    first, second = F.col("cut_bytes")[0], F.col("cut_bytes")[1]
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, F.octet_length("_bytes"))
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = lambda x: F.when(F.col("form") != "plain", F.col(x)).alias(x)
    return c.select(*kept, "n", "form", cut("prefix_units"), cut("middle_units"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that output and form tell: each mark stands in it once, as texts with a mark stay plain."""
    after = lambda s, mark: F.substring_index(s, mark, -1)
    upto = lambda s, mark: F.substring_index(s, mark, 1)
    psm = F.concat(upto(after(output, PREFIX), SUFFIX), after(output, MIDDLE), upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), after(output, MIDDLE), upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
