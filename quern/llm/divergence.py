"""How sources of a language differ: probabilities of common terms, divergence of pairs, leading terms of each source.

Ranking is a radix select: histograms over the bits of the values, summed map-side, tell in which
bucket each group's last rank falls; only rows of that bucket go to the next digit, and rows tied
in all bits go on by the bytes of their term. Divergence of pairs is sparse: every pair starts from
the value it would have if no term occurred, each term adds what it changes, and a pair costs work
for a term only if both sources have it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import byte_slices, narrow_batches, written

#: Bytes that stand in terms, lower-cased; others become a blank. UTF-8 of code points above 127 has only bytes above 127.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at once, and distinct (language, source, term) that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 600_000
SCALE = 1_000_000_000
#: Sources of a language that meet in one group; a larger number is dealt to blocks that meet pair by pair.
SOURCE_BLOCK = 256
#: Pairs of sources whose sums a task holds before it hands them on, pairs computed at once, rows a batch.
HELD_PAIRS, PAIRS_AT_ONCE = 1 << 20, 1 << 18
#: Most groups whose few numbers are broadcast; more are joined by a salted shuffle.
MAX_BROADCAST_GROUPS, SALTS = 20_000, 64
#: Bits of a radix digit, the first one aside; bytes of a term taken as one digit.
DIGIT, TERM_DIGIT = 16, 3


def _terms(text: bytes) -> Iterator[bytes]:
    """Terms of a whole text, cut at the first blank behind each PIECE bytes."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            while end < len(text) and TERM_BYTES[text[end]] != 32:
                end += 1
        yield from text[start:end].translate(TERM_BYTES).split()
        start = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n occurrences, d rows with the term; and a row with a null term for each group that occurs.

    Rows are pre-aggregated in their task, HELD distinct terms at a time.
    """
    narrow_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    schema = "lang string, source string, term string, n long, d long"
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), terms in held.items():
                items = [(None, [0, 0]), *terms.items()]
                for first in range(0, len(items), 20_000):
                    part = items[first : first + 20_000]
                    names = pa.array([None if t is None else t.decode("utf-8", "replace") for t, _ in part], pa.string())
                    yield pa.record_batch([pa.array([a] * len(part)), pa.array([b] * len(part)), names, pa.array([x[0] for _, x in part]), pa.array([x[1] for _, x in part])], schema=out)
            held.clear()

        for batch in batches:
            langs, sources, texts = (c.to_pylist() for c in batch.columns)
            for first, last in byte_slices(texts):
                for i in range(first, last):
                    mine, seen = held[langs[i], sources[i]], defaultdict(int)
                    for t in _terms(texts[i]):
                        seen[t] += 1
                    before = len(mine)
                    for t, n in seen.items():
                        x = mine[t]
                        x[0] += n
                        x[1] += 1
                    size += len(mine) - before
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    part = rows.mapInArrow(count, schema)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 1) / total) in whole numbers, for totals up to 9 * 10^13: the quotient by 10^5, then its rest by 10^4."""
    high = (n + 1) * 100_000
    return F.when(total > 0, 1 + _div(high, total) * 10_000 + _div(high % total * 10_000, total))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.call_function("div", a, b)


def gain(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _small(df: DataFrame) -> bool:
    return df.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS


def _at_group(rows: DataFrame, groups: DataFrame, keys: list[str], salt: Column, small: bool) -> DataFrame:
    """rows with their group's numbers: by broadcast behind a count, else by a join on the keys and a salt, so a hot group is many keys."""
    if small:
        return rows.join(F.broadcast(groups), keys)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def top_of_groups(rows: DataFrame, keys: list[str], value: str, term: str, k: int, small: bool) -> DataFrame:
    """The k rows of each group with the largest value (not negative), ties by the UTF-8 bytes of term, ascending.

    A digit at a time: the histogram of the undecided rows of each group tells the bucket where
    rank k falls. Rows before it are taken, rows behind it go, the others go on, so each turn reads
    only one bucket a group. The first digit is the number of bits and the ten bits behind the
    leading one; then DIGIT bits a turn; a group whose bucket holds one value alone goes on by
    TERM_DIGIT bytes of the term a turn. It ends when every group's last bucket is taken as a
    whole. Rows equal in value and term are equally good: a group keeps as many as fit. small
    says that the groups are few enough for their borders to be broadcast.
    """
    v = F.col(value)
    bits = F.when(v > 0, F.length(F.bin(v))).otherwise(0)
    shifted = lambda n: F.call_function("shiftright", v, n)
    byte = lambda i: F.when(F.octet_length(term) > F.col("_at") + i, 1 + F.conv(F.hex(F.substring(F.col(term).cast("binary"), F.col("_at") + i + 1, F.lit(1))), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    # _shift: bits of the value that are still open; _at: bytes of the term that are decided, -1 while bits are open
    undecided = rows.withColumn("_shift", F.greatest(bits - 11, F.lit(0))).withColumn("_digit", bits.cast("long") * 2048 + shifted(F.col("_shift")))
    undecided = undecided.withColumn("_at", F.lit(-1)).withColumn("_left", F.lit(k).cast("long"))
    taken: DataFrame | None = None
    while True:
        counts = undecided.groupBy(*keys, "_digit").agg(F.count("*").alias("_n"), F.max("_left").alias("_left"), (F.min(v) == F.max(v)).alias("_tied"), (F.min(term) == F.max(term)).alias("_same"))
        down = W.partitionBy(*keys).orderBy(F.desc("_digit")).rowsBetween(W.unboundedPreceding, 0)
        upto = counts.withColumn("_upto", F.sum("_n").over(down))
        # the first bucket that reaches rank k; a group with fewer rows has none and is taken as a whole
        border = upto.groupBy(*keys).agg(F.max(F.when(F.col("_upto") >= F.col("_left"), F.struct("_digit", "_n", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_need"), "_tied", "_same"))).alias("_b"))
        border = border.select(*keys, F.col("_b._digit").alias("_edge"), F.col("_b._n").alias("_in_edge"), F.col("_b._need").alias("_need"), F.col("_b._tied").alias("_tied"), F.col("_b._same").alias("_same"))
        seen = _at_group(undecided.drop("_left"), border if small else written(border, "radix-border"), keys, F.col(term), small)
        whole = F.col("_edge").isNull() | (F.col("_digit") > F.col("_edge")) | (F.col("_digit") == F.col("_edge")) & (F.col("_in_edge") == F.col("_need"))
        seen = written(seen.where(F.col("_edge").isNull() | (F.col("_digit") >= F.col("_edge"))).withColumn("_taken", whole), "radix-rows")
        got = seen.where("_taken").select(*rows.columns)
        taken = got if taken is None else taken.unionByName(got)
        rest = seen.where("not _taken").withColumnRenamed("_need", "_left")
        alike, some = rest.agg(F.bool_and(F.col("_tied") & F.col("_same")), F.count("*")).first()
        if not some:
            return taken
        if alike:  # what is left in any group is equal in value and term
            number = F.row_number().over(W.partitionBy(*keys).orderBy(term))
            return taken.unionByName(rest.withColumn("_number", number).where("_number <= _left").select(*rows.columns))
        rest = rest.withColumn("_at", F.when(F.col("_at") >= 0, F.col("_at") + TERM_DIGIT).when(F.col("_tied"), 0).otherwise(-1))
        rest = rest.withColumn("_shift", F.greatest(F.col("_shift") - DIGIT, F.lit(0)))
        by_term = F.lit(0).cast("long")
        for i in range(TERM_DIGIT):
            by_term = by_term * 257 + byte(i)
        digit = F.when(F.col("_at") >= 0, -by_term).otherwise(shifted(F.col("_shift")))
        undecided = rest.withColumn("_digit", digit).drop("_edge", "_in_edge", "_tied", "_same", "_taken")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """lang, source, item, part: what terms that both sources have add to the divergence, beyond what each adds alone.

    rows: lang and two lists of (source, p of the term there, p0 of a term that doesn't occur
    there); each source of the left meets each of the right, both ways; where the right is
    null, those of the left meet each other.
    """
    schema = "lang string, source string, item string, part long"
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        names: dict = {}
        back: list = []

        def number(x: tuple[str, str]) -> int:
            if x not in names:
                names[x] = len(back)
                back.append(x)
            return names[x]

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(sums.items())
            sums.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.record_batch([pa.array([back[a][0] for (a, _), _ in part], pa.string()), pa.array([back[a][1] for (a, _), _ in part], pa.string()), pa.array([back[b][1] for (_, b), _ in part], pa.string()), pa.array([v for _, v in part], pa.int64())], schema=out)
            names.clear()
            back.clear()

        def add(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> None:
            code = (a << 32) | b
            order = np.argsort(code, kind="stable")
            code, v = code[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            for c, x in zip(code[first].tolist(), np.add.reduceat(v, first).tolist()):
                key = (c >> 32, c & 0xFFFFFFFF)
                sums[key] = sums.get(key, 0) + x

        def meet(pairs: list[tuple]) -> None:
            a, p, p0, b, q, q0 = (np.concatenate(x) for x in zip(*pairs))
            add(a, b, _gain(p, q) - _gain(p, q0) - _gain(p0, q) + _gain(p0, q0))

        for batch in batches:
            langs = batch.column(0).to_pylist()
            sides = []
            for c in (batch.column(1), batch.column(2)):
                flat = c.flatten()
                sides.append((c.is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), flat.field("source").to_pylist(), flat.field("p").to_numpy(zero_copy_only=False), flat.field("p0").to_numpy(zero_copy_only=False)))
            todo, size = [], 0
            for r, lang in enumerate(langs):
                view = []
                for valid, ends, names_, p, p0 in sides:
                    at = slice(int(ends[r]), int(ends[r + 1]))
                    view.append((np.array([number((lang, x)) for x in names_[at]], np.int64), p[at], p0[at]) if valid[r] else None)
                left, right = view[0], view[1]
                n = len(left[0])
                if right is None:
                    i, j = np.nonzero(~np.eye(n, dtype=bool))
                    todo.append(tuple(x[i] for x in left) + tuple(x[j] for x in left))
                    size += n * n
                else:
                    i, j = (x.ravel() for x in np.mgrid[0:n, 0 : len(right[0])])
                    todo += [tuple(x[i] for x in left) + tuple(x[j] for x in right), tuple(x[j] for x in right) + tuple(x[i] for x in left)]
                    size += 2 * n * len(right[0])
                if size > PAIRS_AT_ONCE:
                    meet(todo)
                    todo, size = [], 0
                    if len(sums) > HELD_PAIRS:
                        yield from flush()
            if todo:
                meet(todo)
            if len(sums) > HELD_PAIRS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, schema)


def _alone(rows: DataFrame) -> DataFrame:
    """lang, source, item, part: the divergence of all pairs of a cell if no term were common to two sources.

    rows: lang, v kept terms, and two lists as in _pair_sums of (source, p0, counts, times, total):
    times[i] terms occur counts[i] times in the source, whose sum with v is total. A term's
    probability depends on its count alone, so a source adds its distinct counts, not its terms.
    """
    schema = "lang string, source string, item string, part long"
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left, right, v = r["left"], r["right"], r["v"]
                every = left + (right or [])
                ps = [np.array(s["p"], np.int64) for s in every]
                times = [np.array(s["times"], np.int64) for s in every]
                p0 = np.array([s["p0"] or 1 for s in every], np.int64)
                base = v * _gain(p0[:, None], p0[None, :])
                for i in range(len(every)):
                    # terms of i that another source lacks, as first and as second of the pair
                    if len(ps[i]):
                        none = _gain(p0[i], p0)
                        base[i] += (times[i][:, None] * (_gain(ps[i][:, None], p0[None, :]) - none)).sum(0)
                        none = _gain(p0, p0[i])
                        base[:, i] += (times[i][:, None] * (_gain(p0[None, :], ps[i][:, None]) - none)).sum(0)
                n, m = len(left), len(every)
                mask = ~np.eye(m, dtype=bool)
                if right is not None:
                    mask[:n, :n] = False
                    mask[n:, n:] = False
                i, j = np.nonzero(mask)
                names = [s["source"] for s in every]
                for k in range(0, len(i), 50_000):
                    a, b = i[k : k + 50_000], j[k : k + 50_000]
                    yield pa.record_batch([pa.array([r["lang"]] * len(a), pa.string()), pa.array([names[x] for x in a], pa.string()), pa.array([names[x] for x in b], pa.string()), pa.array(base[a, b])], schema=out)

    return rows.mapInArrow(run, schema)


def _cells(rows: DataFrame, keys: list[str], entry: Column) -> DataFrame:
    """rows (lang, source, _blocks, ...) grouped by keys and pair of blocks: lists left and right of entries; right is null within a block.

    With _blocks blocks of sources, a row goes to that many groups, and no group holds more than
    about two blocks of sources, however many a language has.
    """
    block = F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int")
    dealt = rows.withColumn("_mine", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other"))
    side = lambda i: F.collect_list(F.when(F.col("_mine") == F.col(i), entry))
    g = dealt.groupBy(*keys, "_i", "_j").agg(side("_i").alias("left"), side("_j").alias("_right"))
    return g.select(*keys, "left", F.when(F.col("_i") != F.col("_j"), F.col("_right")).alias("right")).where((F.size("left") > 0) & (F.col("right").isNull() & (F.size("left") > 1) | (F.size("right") > 0)))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others and from the language.

    Terms are runs of letters A to Z, lower-cased, and of code points above 127; a language keeps
    those in at least `least` of its rows. A term that occurs n of N times in a group has
    p = 1 + floor(10^9 (n + 1) / (N + V)), V being the language's kept terms, and against q it
    gains floor((p - q)^2 / q). Part pair ranks the other sources by the gain summed over all kept
    terms; part term ranks the source's own terms with p above the language's, to rank `top`.

    Null text, lang and source are empty strings; each row is a document, also a repeated one; a
    group without terms has p of count 0 everywhere, a language that keeps none has pairs of value
    0; an empty table gives an empty result; other columns aren't read. All numbers are whole and
    exact for up to 9 * 10^13 kept occurrences a language. Pairs of sources are the result's own
    size: a language with S sources has S (S - 1) of them.
    """
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    groups = counts.where("term is null").select("lang", "source")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("d")).where(F.col("d") >= least)
    kept = counts.where("term is not null").drop("d").join(terms.select("lang", "term", "all_n"), ["lang", "term"])
    kept = written(kept, "kept-terms")
    of_lang = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("_sources")).join(of_lang, "lang", "left")
    of_lang = of_lang.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.ceil(F.col("_sources") / SOURCE_BLOCK).cast("int").alias("_blocks"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    numbers = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang")
    numbers = written(numbers.select("lang", "source", "v", "lang_n", "_blocks", (F.coalesce("group_n", F.lit(0)) + F.col("v")).alias("total")), "group-numbers")
    small = _small(numbers)
    at = _at_group(kept, numbers, ["lang", "source"], F.col("term"), small).withColumn("p", probability(F.col("n"), F.col("total"))).withColumn("p0", probability(F.lit(0).cast("long"), F.col("total")))
    at = written(at.withColumn("q", probability(F.col("all_n"), F.col("lang_n") + F.col("v"))), "term-probabilities")

    leading = at.where("p > q").select("lang", "source", "term", gain(F.col("p"), F.col("q")).alias("value"))
    chosen = top_of_groups(leading, ["lang", "source"], "value", "term", top, small).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    together = _pair_sums(_cells(at, ["lang", "term"], F.struct("source", "p", "p0")).select("lang", "left", "right"))
    histogram = at.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    histogram = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("h"))
    shape = numbers.join(histogram, ["lang", "source"], "left").withColumn("p0", probability(F.lit(0).cast("long"), F.col("total")))
    empty = F.array().cast("array<bigint>")
    entry = F.struct("source", "p0", F.coalesce(F.col("h.p"), empty).alias("p"), F.coalesce(F.col("h.times"), empty).alias("times"))
    apart = _alone(_cells(shape, ["lang", "v"], entry))
    pairs = apart.unionByName(together).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return chosen.unionByName(pairs).withColumn("rank", F.row_number().over(order))
