"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, DataFrame functions only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: A paragraph is a line; a longer line is cut after the sentence that reaches so many characters,
LEAST_CHARS = 40
#: or, where no sentence ends before the second number, before the first white space from the first number on.
WORDS_CHARS, SENTENCE_CHARS = 120, 160
#: A table has three parts of so many cells; a digest sits in one cell of each part.
PART = 8
#: Rounds of peeling; tables of this size are empty or stuck before.
ROUNDS = 10
#: Digests on either side of which the difference is peeled from one table at first.
LOAD = 4
#: After a failure the sketch is made larger: its tables, in turn.
RETRIES = (4, 16, 64)
#: Buckets of the id range for each shuffle partition, and the most buckets.
BUCKETS_PER_PARTITION, MAX_BUCKETS = 4, 9216

_PIECES = rf"[^\n]{{{LEAST_CHARS},{SENTENCE_CHARS}}}?(?:[.!?…](?=\s|$)|[。！？।])|[^\n]{{{WORDS_CHARS},}}?(?=\s|$)|[^\n]+"
PARTS = ("c0", "c1", "c2")


def _places() -> Column:
    return F.array(*[F.lit(i) for i in range(PART)])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs, in order; empty for a null text."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _entry(key: Column, n: Column) -> Column:
    """A digest with its count, its check and its cell in each part."""
    place = lambda bits: F.shiftrightunsigned(key, bits).bitwiseAND(F.lit(PART - 1)).cast("int")
    return F.struct(key.alias("key"), n.alias("n"), F.xxhash64(key).alias("chk"), place(20).alias("c0"), place(31).alias("c1"), place(42).alias("c2"))


def _cell(n: Column, key: Column, chk: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), chk.alias("chk"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _put(cell: Column, e: Column) -> Column:
    return _cell(cell["n"] + e["n"], cell["key"].bitwiseXOR(e["key"]), cell["chk"].bitwiseXOR(e["chk"]))


def _into(part: str, cell: Column, place: Column, entries: Column) -> Column:
    """The cell at a place of a part after all entries that sit there."""
    return F.aggregate(entries, cell, lambda c, e: F.when(e[part] == place, _put(c, e)).otherwise(c))


def _cells(part: str, entries: Column) -> Column:
    return F.transform(_places(), lambda i: _into(part, _zero(), i, entries))


def _add(part: str, cells: Column, entries: Column) -> Column:
    return F.transform(cells, lambda c, i: _into(part, c, i, entries))


def entries(keys: Column) -> Column:
    return F.transform(keys, lambda k: _entry(k, F.lit(1)))


def table(own: Column) -> Column:
    """One table of entries: the parts c0, c1, c2."""
    return F.struct(*[_cells(part, own).alias(part) for part in PARTS])


def _deal(own: Column, groups: Column) -> Column:
    """array<array<entry>>: entries dealt over groups (a power of two) by low bits of the digest, in two steps of about the root of groups."""
    side = F.pow(F.lit(2.0), F.ceil(F.log2(groups.cast("double")) / 2)).cast("long")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)

    def fine(c: Column) -> Column:
        part = lambda g: F.get(c["parts"], g.bitwiseAND(c["side"] - 1).cast("int"))
        return F.transform(numbers(c["groups"]), lambda g: F.filter(part(g), lambda e: e["key"].bitwiseAND(c["groups"] - 1) == g))

    coarse = lambda c: F.transform(numbers(c["side"]), lambda g: F.filter(c["own"], lambda e: e["key"].bitwiseAND(c["side"] - 1) == g))
    return _let(F.struct(own.alias("own"), side.alias("side"), groups.alias("groups")), lambda c: _let(F.struct(coarse(c).alias("parts"), c["side"].alias("side"), c["groups"].alias("groups")), fine))


def groups_of(keys: Column) -> Column:
    """Tables of a digest list's fingerprint: the power of two that leaves a table at most LOAD digests on average."""
    return F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(keys), F.lit(1)) / F.lit(float(LOAD))))).cast("long"), F.lit(1).cast("long"))


def own_sketch(keys: Column, groups: Column) -> Column:
    """array<table> of a digest list: the fingerprint's cells."""
    return F.transform(_deal(entries(keys), groups), table)


def sketch(own: Column, tables: Column) -> Column:
    """array<table>: entries dealt over tables (a power of two) by high bits of the digest."""
    numbers = F.sequence(F.lit(0).cast("long"), tables - 1)
    return F.transform(numbers, lambda t: _let(F.filter(own, lambda e: F.shiftrightunsigned(e["key"], 50).bitwiseAND(tables - 1) == t), table))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell a - b, for sketches of equal shape: what both hold vanishes."""
    minus = lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"]))
    return F.zip_with(a, b, lambda s, t: F.struct(*[F.zip_with(s[p], t[p], minus).alias(p) for p in PARTS]))


def peel(table: Column) -> Column:
    """The differing digests of one subtracted table: found (with their sign), and left, its cells that aren't empty.

    Each round takes all cells that hold one digest and removes these digests from all their cells.
    """

    def step(state: Column, pure: Column) -> Column:
        parts = [_add(p, state[p], pure).alias(p) for p in PARTS]
        return F.struct(*parts, F.concat(state["found"], F.transform(pure, lambda e: F.struct(e["key"].alias("key"), (-e["n"]).alias("n")))).alias("found"), (F.size(pure) == 0).alias("stuck"))

    def round_(state: Column, _: Column) -> Column:
        single = F.filter(F.concat(*[state[p] for p in PARTS]), lambda c: F.when((c["n"] == 1) | (c["n"] == -1), F.xxhash64(c["key"]) == c["chk"]).otherwise(False))
        pure = F.array_distinct(F.transform(single, lambda c: _entry(c["key"], -c["n"])))
        return F.when(state["stuck"], state).otherwise(_let(pure, lambda p: step(state, p)))

    start = F.struct(*[table[p].alias(p) for p in PARTS], F.array().cast("array<struct<key:bigint,n:int>>").alias("found"), F.lit(False).alias("stuck"))
    end = F.aggregate(F.array(*[F.lit(0)] * ROUNDS), start, round_)
    return _let(end, lambda e: F.struct(e["found"].alias("found"), F.filter(F.concat(*[e[p] for p in PARTS]), lambda c: (c["n"] != 0) | (c["key"] != 0)).alias("left")))


def difference(a: Column, b: Column, tables: Column) -> Column:
    """The digests (key, n: 1 only in a, -1 only in b) in which two sketches of so many tables differ; null if peeling gets stuck."""
    peeled = F.transform(subtract(sketch(a, tables), sketch(b, tables)), peel)
    return _let(peeled, lambda p: F.when(F.forall(p, lambda t: F.size(t["left"]) == 0), F.flatten(F.transform(p, lambda t: t["found"]))))


def differing(a: Column, b: Column) -> Column:
    """The digests (key, n: 1 only in a, -1 only in b) in which two digest lists differ."""
    sketched = lambda x: F.struct(x.alias("keys"), own_sketch(x, groups_of(x)).alias("tables"))
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: _let(F.struct(sketched(p["a"]).alias("a"), sketched(p["b"]).alias("b")), lambda q: difference_of(q["a"], q["b"])))


def difference_of(a: Column, b: Column) -> Column:
    """The digests in which two texts differ, from their sketches. a, b: structs of tables (the fingerprint's cells) and keys.

    The two are subtracted table by table and peeled. The shorter text's sketch is made as
    large as the other's before; a table that gets stuck is made larger for both texts, again
    and again; if the largest is stuck too, the digests decide.
    """
    only = lambda x, y, n: F.transform(F.array_except(F.transform(x, lambda e: e["key"]), F.transform(y, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.lit(n).alias("n")))
    groups = F.greatest(F.size(a["tables"]), F.size(b["tables"])).cast("long")
    sized = lambda x, n: F.when(F.size(x["tables"]) == n, x["tables"]).otherwise(own_sketch(x["keys"], n))

    def larger(x: Column, y: Column) -> Column:
        attempts = F.aggregate(F.array(*[F.lit(r).cast("long") for r in RETRIES]), F.lit(None).cast("array<struct<key:bigint,n:int>>"), lambda found, times: F.when(found.isNotNull(), found).otherwise(difference(x, y, times)))
        return F.coalesce(attempts, F.concat(only(x, y, 1), only(y, x, -1)))

    def resolved(c: Column) -> Column:
        of = lambda keys, g: F.filter(entries(keys), lambda e: e["key"].bitwiseAND(c["groups"] - 1) == g)
        again = lambda g: _let(F.struct(of(a["keys"], g).alias("a"), of(b["keys"], g).alias("b")), lambda both: larger(both["a"], both["b"]))
        return F.flatten(F.transform(c["peeled"], lambda t, g: F.when(F.size(t["left"]) == 0, t["found"]).otherwise(again(g))))

    start = lambda n: F.struct(n.alias("groups"), F.transform(subtract(sized(a, n), sized(b, n)), peel).alias("peeled"))
    return _let(_let(groups, start), resolved)


def likeness(a: Column, b: Column) -> Column:
    """The share of both texts' digests that the difference of their sketches leaves in common; 1 for two empty ones."""
    both = (F.size(a["keys"]) + F.size(b["keys"])).cast("double")
    return F.when(both == 0, F.lit(1.0)).otherwise((both - F.size(difference_of(a, b))) / both)


def as_text(side: Column) -> Column:
    """A fingerprint as text: the number of digests, then the tables after ";", each of 24 cells with "," between.

    A cell is empty or count.key+check in hexadecimal, 16 digits of key and 8 of check (the
    low half of xxhash64 of the key, seed 42); cells 0-7, 8-15, 16-23 are the three parts.
    Digest k sits in table k mod the number of tables, in each part in the cell of three
    bits of k from bit 20, 31 and 42.
    """
    cell = lambda c: F.when((c["n"] == 0) & (c["key"] == 0), "").otherwise(F.concat(F.hex(c["n"]), F.lit("."), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["chk"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    tables = F.transform(side["tables"], lambda t: F.array_join(F.transform(F.concat(*[t[p] for p in PARTS]), cell), ","))
    return F.concat_ws(";", F.size(side["keys"]).cast("string"), F.array_join(tables, ";"))


def compared(keys: Column, edited: Column, following: Column) -> Column:
    """The fingerprints of a text and its edited text as text, and how like the first is to the second and to the next text's."""
    side = lambda x: F.struct(x.alias("keys"), own_sketch(x, groups_of(x)).alias("tables"))

    def out(s: Column) -> Column:
        return F.struct(as_text(s["own"]).alias("fingerprint"), as_text(s["edited"]).alias("edited_fingerprint"), likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], s["next"]).alias("near_next"))

    lists = F.struct(keys.alias("own"), edited.alias("edited"), following.alias("next"))
    return _let(lists, lambda k: _let(F.struct(*[side(k[n]).alias(n) for n in ("own", "edited", "next")]), out))


def _ordered_value(docs: DataFrame, doc_id: str) -> Column:
    """A double that never falls where the id rises; six bytes behind the common beginning for an id that isn't a number."""
    at = F.col(f"`{doc_id}`")
    if isinstance(docs.schema[doc_id].dataType, NumericType):
        return at.cast("double")
    low, high = docs.agg(F.min(at.cast("string")), F.max(at.cast("string"))).first()
    begin = len(os.path.commonprefix([low.encode(), high.encode()])) if low is not None else 0
    return F.conv(F.rpad(F.hex(F.substring(at.cast("string").cast("binary"), begin + 1, 6)), 12, "0"), 16, 10).cast("double")


def beside_next(docs: DataFrame, values: list[str], doc_id: str = "doc_id", tie: str = "text") -> DataFrame:
    """docs with next_<value>: the values of the next row by descending id, after the last those of the first.

    Null ids come last, equal ids by md5 of tie. Ids are cut into ranges at approximate
    quantiles, rows shuffled once by range and put in order inside it; the first row of each
    range is also sent to the range before. What the driver sees is one id a range.
    """
    spark = docs.sparkSession
    wanted = min(MAX_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    value = _ordered_value(docs, doc_id)
    ids = docs.select(value.alias("i")).where("i is not null")
    cuts = sorted(set(ids.approxQuantile("i", [j / wanted for j in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []), reverse=True)
    side = max(1, int(len(cuts) ** 0.5))
    fine = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    coarse = F.array(*[F.lit(c) for c in cuts[::side]]).cast("array<double>")
    group = F.greatest(F.size(F.filter(coarse, lambda c: c > value)) - 1, F.lit(0))
    within = F.size(F.filter(F.slice(fine, group * side + 1, F.lit(side)), lambda c: c > value))
    placed = docs.withColumn("_b", F.when(value.isNull(), len(cuts) + 1).otherwise(group * side + within))

    firsts = {r[0]: r[1] for r in placed.groupBy("_b").agg(F.max(f"`{doc_id}`")).collect()}
    held = sorted(firsts)
    before = {b: held[j - 1] for j, b in enumerate(held)}
    first_id = F.array(*[F.lit(firsts.get(b)) for b in range(len(cuts) + 2)]).cast(f"array<{dict(docs.dtypes)[doc_id]}>")
    previous = F.array(*[F.lit(before.get(b, 0)) for b in range(len(cuts) + 2)])
    own = F.struct(F.col("_b").cast("int").alias("b"), F.lit(False).alias("extra"))
    first = F.get(first_id, F.col("_b")).eqNullSafe(F.col(f"`{doc_id}`"))
    places = F.when(first, F.array(own, F.struct(F.get(previous, F.col("_b")).cast("int").alias("b"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    # plain columns: each window over an expression would deal out the texts anew
    rows = placed.withColumn("_tie", F.md5(F.col(f"`{tie}`").cast("binary"))).withColumn("_place", F.explode(places))
    rows = rows.select(*docs.columns, "_tie", F.col("_place.b").alias("_range"), F.col("_place.extra").alias("_extra"))
    order = W.partitionBy("_range").orderBy("_extra", F.col(f"`{doc_id}`").desc_nulls_last(), "_tie")
    rows = rows.withColumn("_next", F.lead(F.struct(*values)).over(order)).where(~F.col("_extra"))
    return rows.select(*docs.columns, *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: n_chars, the sketches of its text and of its edited text, and how like they are.

    The edited text has the last third of the characters (rounded down) replaced by as many
    first ones of the next text by descending id. A null text counts as empty; equal texts
    have equal fingerprints; a table of one row is its own next. Other columns are left out.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = beside_next(rows.withColumn("keys", digests(F.col("text"))), ["text", "keys"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "keys", "next_keys", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "keys", "next_keys", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    rows = rows.withColumn("out", compared(F.col("keys"), F.col("edited_keys"), F.col("next_keys")))
    return rows.select("doc_id", "n_chars", "edited_sha256", *[f"out.{n}" for n in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")])
