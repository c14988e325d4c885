import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from quern.llm import fingerprint

PIECES = re.compile(r"[^\n]{120,}?[.!?](?=\s|$)|[^\n]+")


def units(text):
    return {m.group() for m in PIECES.finditer(text or "")}


def like(a, b):
    a, b = units(a), units(b)
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def make(seed, n):
    rng = random.Random(seed)
    lines = [f"Line {i} of {rng.random()}." for i in range(400)]
    return ["\n".join(rng.choices(lines, k=rng.choice([0, 1, 2, 7, 30, 120]))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = [*make(1, 40), "é" * 999, "x" * 300 + ". " + "y" * 130 + "! z", "one"]
    texts += [texts[5], texts[7]]
    keys = random.Random(2).sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.repartition(5)).collect()}
    order = sorted(zip(keys, texts, strict=True), reverse=True)
    prints = {}
    for (k, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(t, edited)) < 1e-9 and abs(r.near_next - like(t, following)) < 1e-9
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len({frozenset(units(t)) for t in texts})


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(3)
    rows = []
    for i, d in enumerate((0, 1, 3, 9, 40, 200)):
        common, left, right = ([rng.getrandbits(63) for _ in range(n)] for n in (50, d, d // 2))
        rows.append((i, common + left, right + common, sorted(left), sorted(right)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, l array<long>, r array<long>")
    for r in df.withColumn("d", fingerprint.differing(F.col("a"), F.col("b"))).collect():
        assert sorted(x.key for x in r.d if x.n == 1) == r.l and sorted(x.key for x in r.d if x.n == -1) == r.r


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a\nb", 3), (1, "a\nb", 3), (None, "c", 4)], "doc_id long, text string, n_chars int")
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 0, 1, 3, 3]
    one = fingerprint.fingerprints(docs.limit(1)).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def parse(print_):
    """Number of digests and the cells (count, key, check) of each table of a fingerprint."""
    n, *tables = print_.split(";")
    cell = lambda c: (int(c.split(".")[0], 16), int(c.split(".")[1][:16], 16), int(c.split(".")[1][16:], 16)) if c else (0, 0, 0)
    return int(n), [[cell(c) for c in t.split(",")] for t in tables]


def recovered(a, b):
    """The digests in which two fingerprints of equal shape differ, by subtracting and peeling them; None if that gets stuck."""
    check = lambda k: xxhash.xxh64(k.to_bytes(8, "little"), seed=42).intdigest() & 0xFFFFFFFF
    out = set()
    for s, t in zip(a, b, strict=True):
        cells = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(s, t, strict=True)]
        while pure := next((c for c in cells if abs(c[0]) == 1 and check(c[1]) == c[2]), None):
            n, k, c = pure
            out.add(k)
            for part, bits in enumerate((20, 31, 42)):
                at = cells[8 * part + (k >> bits & 7)]
                at[:] = [at[0] - n, at[1] ^ k, at[2] ^ c]
        if any(map(any, cells)):
            return None
    return out


def test_fingerprints_alone_recover_the_difference(spark):
    rng = random.Random(4)
    pairs = []
    for n, d in ((1, 0), (3, 1), (40, 2), (200, 9), (900, 30)):
        lines = [f"Line {rng.random()}." for _ in range(n)]
        other = list(lines)
        for i in rng.sample(range(n), d):
            other[i] = f"Other {rng.random()}."
        pairs.append(("\n".join(lines), "\n".join(other), 2 * d))
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    out = df.select("i", fingerprint.compared(*[fingerprint.digests(F.col(c)) for c in ("a", "b", "b")]).alias("o")).collect()
    for r in out:
        a, b = parse(r.o.fingerprint), parse(r.o.edited_fingerprint)
        assert a[0] == b[0] == pairs[r.i][0].count("\n") + 1
        got = recovered(a[1], b[1])
        assert got is not None and len(got) == pairs[r.i][2]
        assert r.o.near_edited == r.o.near_next and abs(r.o.near_edited - (2 * a[0] - len(got)) / (2 * a[0])) < 1e-12
        everything = recovered(a[1], [[(0, 0, 0)] * 24] * len(a[1]))
        assert everything is None or len(everything) == a[0]


def test_string_ids_and_a_long_text(spark):
    rng = random.Random(6)
    long = "\n".join(f"Line {rng.random()}." for _ in range(6000))
    rows = [(f"doc-{i:03}", t) for i, t in enumerate(["a\nb", long, long + "\nmore", None, "a\nb\nc"])] + [(None, "x")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["doc-002"].near_next == 12000 / 12001 and abs(got["doc-004"].near_next) < 1e-12
    assert got["doc-001"].near_next == 0.0 and got[None].near_next == 0.0


def test_texts_of_one_line_keep_their_likeness(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    texts = [
        " ".join(word() for _ in range(400)),  # no sentence
        " ".join(word() + rng.choice(["", "", "", ".", "?"]) for _ in range(200)),
        "".join(chr(rng.randint(0x4E00, 0x9000)) + ("。" if i % 30 == 29 else "") for i in range(900)),
    ]
    edited = [t[: len(t) - len(t) // 3] + "zyx " * (len(t) // 12) for t in texts]
    rows = list(zip(range(3), texts, edited, texts[1:] + texts[:1], strict=True))
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    out = df.select("i", F.size(fingerprint.digests(F.col("a"))).alias("n"), fingerprint.compared(*[fingerprint.digests(F.col(c)) for c in "abc"]).alias("o")).collect()
    for r in out:
        assert r.n > 6 and 0.45 < r.o.near_edited < 0.75 and r.o.near_next == 0.0
        assert r.n <= len(texts[r.i]) / 30
