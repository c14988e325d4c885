import itertools
import random

import numpy as np

from quern.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = np.random.default_rng(1)
    pairs, want = [], []
    for _ in range(600):
        a = rng.integers(0, 6, rng.integers(0, 90)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 25)):
            i, op = int(rng.integers(0, len(b) + 1)), rng.integers(3)
            if op == 0:
                b.insert(i, int(rng.integers(0, 6)))
            elif b:
                b[min(i, len(b) - 1) :][:1] = []
                del b[min(i, len(b) - 1)]
                if op == 2:
                    b.insert(i, int(rng.integers(0, 6)))
        limit = int(rng.integers(0, 30))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32), limit))
        want.append(distance(a, b) <= limit)
    assert neardup.distances_within(pairs).tolist() == want


def texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 200]))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def classes(rows):
    """Components of all pairs that are similar, by brute force; texts without words are alone."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items, begin = neardup.shingles([t.encode() if t else None for t in rows])
    seqs = [items[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = seqs[i], seqs[j]
        if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and set(a) & set(b) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return [find(i) for i in range(len(rows))]


def test_classes_against_brute_force(spark):
    rows = [*texts(), None, "", "   ", "one", "one"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, group_id string")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs.repartition(3)).collect()}
    want = classes(rows)
    assert [got[i].group_id for i in range(len(rows))] == want
    for root in set(want):
        members = [got[i] for i, r in enumerate(want) if r == root]
        assert [m.group_size for m in members] == [len(members)] * len(members) and sum(m.keep for m in members) == 1
    kept = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in got if got[i].keep}


def test_crowded_buckets_and_repeated_rows(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(80):  # one class, larger than a bucket that is compared pair by pair
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    rows += [(200, "same words here"), (200, "same words here"), (None, "same words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert {r.group_id for r in got if r.doc_id is not None and r.doc_id < 80} == {0}
    assert sum(r.keep for r in got if r.group_size == 3) == 1
    assert neardup.drop_near_duplicates(docs).count() == sum(r.keep for r in got)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_many_classes_in_crowded_buckets(spark):
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for c in range(60):  # two texts each, linked mostly by the passage that all classes share
        own = [f"c{c}x{i}" for i in range(5)]
        rows += [" ".join([*passage, *own, *[f"t{c}x{side}x{i}" for i in range(8)]]) for side in range(2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(rows))] == classes(rows) == [i - i % 2 for i in range(len(rows))]


def test_texts_of_a_common_head_leave_crowded_buckets(spark):
    head = [f"p{i}" for i in range(30)]
    unlike = [" ".join([*head, *[f"t{i}x{k}" for k in range(30)]]) for i in range(150)]
    # a chain of twelve texts that differ from the next in four words, behind the same head
    tail, chain = [f"c{k}" for k in range(30)], []
    for i in range(12):
        tail = [f"n{i}x{k}" if 2 * i <= k < 2 * i + 2 else w for k, w in enumerate(tail)]
        chain.append(" ".join([*head, *tail]))
    rows = [*unlike, *chain]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(rows))] == classes(rows)
    items, begin = neardup.shingles([t.encode() for t in rows])
    low = (items >> np.uint64(32)).astype(np.uint32)
    keys = [i.to_bytes(16, "big") for i in range(len(rows))]
    sequences = spark.createDataFrame([(bytearray(k), bytearray(low[a:b].tobytes())) for k, a, b in zip(keys, begin[:-1], begin[1:], strict=True)], "key binary, seq binary")
    parts = neardup._parts(spark.createDataFrame([(bytearray(k), bytearray(k)) for k in keys], "key binary, root binary"), sequences, neardup.SIMILARITY).collect()
    assert {bytes(r.key) for r in parts} == set(keys[150:]) and len({bytes(r.part) for r in parts}) == 1


def test_parts_keep_similar_nodes_together(spark):
    rng = np.random.default_rng(8)
    seqs = []
    for _ in range(25):
        a = rng.integers(0, rng.integers(20, 400), rng.integers(1, 60)).tolist()
        seqs.append(a)
        for _ in range(3):
            b = list(a)
            for _ in range(rng.integers(0, 1 + len(a) // 4)):
                b[rng.integers(len(b))] = int(rng.integers(0, 400))
            seqs.append(b[: max(1, len(b) - int(rng.integers(0, 4)))])
    keys = [i.to_bytes(16, "big") for i in range(len(seqs))]
    sequences = spark.createDataFrame([(bytearray(k), bytearray(np.array(s, np.uint32).tobytes())) for k, s in zip(keys, seqs, strict=True)], "key binary, seq binary")
    nodes = spark.createDataFrame([(bytearray(k), bytearray(k)) for k in keys], "key binary, root binary")
    part = {bytes(r.key): bytes(r.part) for r in neardup._parts(nodes, sequences, neardup.SIMILARITY).collect()}
    like = [(i, j) for i, j in itertools.combinations(range(len(seqs)), 2) if distance(seqs[i], seqs[j]) <= 0.2 * max(len(seqs[i]), len(seqs[j])) + 1e-9]
    assert len(like) > 20 and all(part[keys[i]] == part[keys[j]] for i, j in like)


def test_blocks_find_all_pairs_across():
    rng = np.random.default_rng(4)
    roots = rng.integers(0, 5, (200, 1)).repeat(2, 1).astype(np.uint64)
    sketch = rng.integers(0, 6, (200, neardup.SAMPLES)) + np.arange(neardup.SAMPLES) * 10
    block, found = (roots, sketch, np.ones(sketch.shape, bool)), []
    for bucket in np.unique(sketch).tolist():
        at = np.flatnonzero((sketch == bucket).any(1))
        part = tuple(x[at] for x in block)
        for i, j, n in neardup.agreeing_across(part, part, bucket, True):
            found += zip(at[i].tolist(), at[j].tolist(), n.tolist(), strict=True)
    want = [(i, j, int((sketch[i] == sketch[j]).sum())) for i, j in itertools.combinations(range(200), 2) if roots[i, 0] != roots[j, 0]]
    assert sorted(found) == [x for x in want if x[2] >= neardup.AGREE]


def test_many_equal_rows(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    docs = spark.createDataFrame([(1, one)] * 300 + [(2, two)] * 300 + [(i, one) for i in range(10, 20)], "doc_id long, text string").repartition(4)
    light, plan = neardup.classes(docs)
    assert plan.count() == 2 and {r.group_size for r in plan.collect()} == {610}
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 610 and {r.group_id for r in got} == {1} and sum(r.keep for r in got) == 1
    assert neardup.drop_near_duplicates(docs).count() == 1


def test_hot_text_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    rows = [(i, "same words in every row") for i in range(20)] + [(50, "other words alone here"), (51, None), (52, "")]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 23 and {got[i].group_id for i in range(20)} == {0} and sum(r.keep for r in got.values()) == 4
    assert [got[i].group_id for i in (50, 51, 52)] == [50, 51, 52]


def test_recall_near_the_threshold():
    """Of pairs whose similarity is just above the limit at least 0.98 agree in enough samples."""
    rng = random.Random(12)
    texts = []
    for _ in range(400):
        words = [f"w{rng.getrandbits(40)}" for _ in range(200)]
        copy = list(words)
        for i in rng.sample(range(200), 7):  # up to 35 of 196 shingles
            copy[i] = f"x{rng.getrandbits(40)}"
        texts += [" ".join(words).encode(), " ".join(copy).encode()]
    items, begin = neardup.shingles(texts)
    seqs = [items[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    good = neardup.similar(list(zip(seqs[::2], seqs[1::2], strict=True)))
    keys = np.array(neardup.sketches(texts))
    agree = (keys[::2] == keys[1::2]).sum(1) >= neardup.AGREE
    assert good.mean() > 0.95 and agree[good].mean() >= 0.98


def test_links_join_all_classes_of_similar_pairs():
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 2**31, 80).astype(np.uint32) for _ in range(3)]
    seqs = []
    for k in range(90):
        s = bases[k % 3].copy()
        s[rng.choice(80, rng.integers(0, 25), replace=False)] = rng.integers(0, 2**31)
        seqs.append(s)
    sketch = np.ones((90, neardup.SAMPLES), np.int64)
    block = (np.arange(90), sketch, np.ones(sketch.shape, bool), seqs)

    def closed(pairs):
        root = list(range(90))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    part = lambda at: (block[0][at, None], *[[x[k] for k in at] if isinstance(x, list) else x[at] for x in block[1:]])
    limit = int(0.2 * 80 + 1e-9)
    want = closed((i, j) for i, j in itertools.combinations(range(90), 2) if distance(seqs[i].tolist(), seqs[j].tolist()) <= limit)
    every = np.arange(90)
    links = list(neardup.links_across(part(every), part(every), 1, True))
    assert closed(links) == want and len(links) == 90 - len(set(want))
    a, b = every[:50], every[50:]
    links = [(int(x[i]), int(y[j])) for x, y, same in ((a, a, True), (b, b, True), (a, b, False)) for i, j in neardup.links_across(part(x), part(y), 1, same)]
    assert closed(links) == want


def test_chain_bounds_the_distance(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.permutation(60)[: rng.integers(1, 60)].astype(np.uint32)
        b = np.concatenate([a[: len(a) // 2], rng.integers(0, 90, rng.integers(0, 20)), a[len(a) // 2 :]]).astype(np.uint32)
        assert neardup._chained(a, b) >= distance(a.tolist(), b.tolist())
    own, other = rng.integers(0, 50, 300).astype(np.uint64), np.sort(rng.integers(0, 50, 900).astype(np.uint64))
    node = rng.integers(0, 7, 900)
    monkeypatch.setattr(neardup, "POSTINGS", 100)
    want = [int(sum((other[node == k] == v).sum() for v in own)) for k in range(7)]
    assert neardup._held(own, other, node, 7).tolist() == want
    a = np.arange(200_000, dtype=np.uint32)
    b = a.copy()
    b[::10] += 1_000_000
    assert neardup.similar([(a, b)]).tolist() == [True]
