"""Near-duplicate documents: Order MinHash candidates, verified by banded alignment.

Texts are sequences of five-word shingles. A sketch sample takes the two shingles, labelled
with their occurrence, that a seeded hash puts first and keeps them in text order, so agreeing
samples mean shared shingles in the same order. Candidates are aligned: two texts are
linked if the edit distance of their shingle sequences is at most a fifth of the longer one.
Linked texts, directly or through others, form a class.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import WORD, byte_slices, narrow_batches, per_text, written
from quern.llm.repetition import _K, _SEPARATOR, _again, _mix, _rolling

#: Words of a shingle, samples of a sketch, and the least similarity of a link.
SHINGLE, SAMPLES, SIMILARITY = 5, 24, 0.8
#: Samples that must agree before a pair is aligned: a pair of the least similarity fails this once in a thousand times.
AGREE = 3
#: Nodes of a bucket up to which all its pairs are counted; a larger one is compared with its pivot, then in blocks.
SMALL = 24
#: Nodes and shingles of a block of a larger bucket, and rows of it that are compared at once.
BLOCK, BLOCK_ITEMS, ROWS = 512, 1 << 18, 64
#: Entries of other nodes with the same shingles that are counted at once.
POSTINGS = 1 << 18
#: Rows of one text above which its plan is broadcast to them, so that they don't meet in one task.
HOT_ROWS = 1000
#: Elements of sequences that are aligned side by side.
BAND_CELLS = 1 << 22
#: Cells of a band from which a chain of unique elements is tried before the alignment.
CHAIN_CELLS = 1 << 26
#: Candidate keys of which a copy is broadcast to filter the texts; above it they are joined by a shuffle.
MAX_BROADCAST_KEYS = 200_000

_SEEDS = np.random.Generator(np.random.PCG64(23)).integers(1, 2**63, SAMPLES, dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingle hashes in order and the offset of each text's first; ASCII capitals count as small.

    A text of fewer words has one shingle of all its words, one without words has none.
    """
    blobs = [t.lower() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    edge = np.diff(_SEPARATOR[data].astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and len(ends) and ends[0] < starts[0]:
        ends = ends[1:]
    words = _rolling(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], counts)
    last = np.repeat(first[1:], counts)
    h = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        inside = at + i < last
        h = h * _K + np.where(inside, words[np.minimum(at + i, max(0, len(words) - 1))] if len(words) else 0, np.uint64(i + 1))
    return _mix(h), begin


def sketches(texts: list[bytes | None]) -> list[list[int] | None]:
    """SAMPLES keys of each text, None for a text without words."""
    out: list = []
    for a, b in byte_slices(texts):
        items, begin = shingles(texts[a:b])
        counts = np.diff(begin)
        full = np.flatnonzero(counts)
        rows: list = [None] * (b - a)
        if len(full):
            starts, sizes = begin[:-1][full], counts[full]
            text_of = np.repeat(np.arange(len(full)), sizes)
            # the occurrence of each shingle in its text
            keys = _mix(items ^ _mix((text_of + 1).astype(np.uint64) * _K))
            order = np.argsort(keys, kind="stable")
            new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
            index = np.arange(len(order))
            occurrence = np.empty(len(order), np.uint64)
            occurrence[order] = index - np.maximum.accumulate(np.where(new, index, 0))
            labelled = items ^ (occurrence * np.uint64(0xA24BAED4963EE407))
            keys = np.empty((len(full), SAMPLES), np.uint64)
            place = np.arange(len(items))
            for j, seed in enumerate(_SEEDS):
                h = _mix(labelled ^ seed)
                at = []
                for _ in range(2):
                    least = np.minimum.reduceat(h, starts)
                    hit = np.flatnonzero(h == least[text_of])
                    p = np.full(len(full), -1)
                    p[text_of[hit]] = place[hit]
                    at.append(p)
                    h[p] = _NONE
                one = sizes == 1
                first, second = np.minimum(*at), np.maximum(*at)
                keys[:, j] = _mix(items[first] * _K + np.where(one, np.uint64(1), items[second]) + seed)
            for i, row in zip(full.tolist(), keys.view(np.int64).tolist(), strict=True):
                rows[i] = row
        out += rows
    return out


def distances_within(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """For each (a, b, limit) whether the edit distance of the sequences is at most limit.

    Common ends are cut off first. What is left is aligned in a band around the diagonal
    that starts narrow and doubles until the distance is inside it or the limit is reached;
    pairs of like length go through the rows of the band together.
    """
    within = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b, limit) in enumerate(pairs):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        a, b = a[head:], b[head:]
        n -= head
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limit:
            continue
        if not len(a):
            within[i] = True  # the rest of b is inserted
            continue
        # each shared element can be matched once at most
        shared = _shared(a, b)
        if len(b) - shared > limit:
            continue
        if len(a) * limit > CHAIN_CELLS and _chained(a, b) <= limit:
            within[i] = True
            continue
        todo.append((i, a, b, limit))
    band = 12
    while todo:
        todo.sort(key=lambda x: (min(x[3], band), len(x[1])))
        later, at = [], 0
        while at < len(todo):
            width = min(band, todo[min(at + 255, len(todo) - 1)][3])
            longest = max(len(x[1]) for x in todo[at : at + 256])
            group = todo[at : at + max(1, min(256, BAND_CELLS // (longest + 2 * width + 1)))]
            at += len(group)
            width = min(band, max(x[3] for x in group))
            found = _banded([(a, b) for _, a, b, _ in group], width, np.array([min(width, x[3]) for x in group]))
            for (i, a, b, limit), d in zip(group, found.tolist(), strict=True):
                if d <= min(width, limit):
                    within[i] = True
                elif width < limit:
                    later.append((i, a, b, limit))
        todo, band = later, band * 4
    return within


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _chained(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edit distance: elements unique in both are matched along a longest chain, what is between is replaced."""
    x, i, n = np.unique(a, return_index=True, return_counts=True)
    y, j, m = np.unique(b, return_index=True, return_counts=True)
    _, p, q = np.intersect1d(x[n == 1], y[m == 1], assume_unique=True, return_indices=True)
    i, j = i[n == 1][p], j[m == 1][q]
    order = np.argsort(i)
    i, j = i[order], j[order].tolist()
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(j)
    for k, v in enumerate(j):
        at = bisect_left(ends, v)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [v], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    chain.reverse()
    one = np.diff(np.concatenate([[-1], i[chain], [len(a)]])) - 1
    two = np.diff(np.concatenate([[-1], np.array(j, np.int64)[chain], [len(b)]])) - 1
    return int(np.maximum(one, two).sum())


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int, limits: np.ndarray) -> np.ndarray:
    """Edit distances (exact where at most its limit, which is at most band) by rows over the diagonals -band to band.

    All pairs go together; one leaves when no cell of its row is within its limit.
    """
    lanes, width = len(pairs), 2 * band + 1
    kind = np.int16 if band < 4096 else np.int32
    far = kind(1 << 13) if kind is np.int16 else kind(1 << 28)
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    steps = int(n.max())
    left = np.zeros((lanes, steps), pairs[0][0].dtype)
    right = np.zeros((lanes, steps + width + 1), pairs[0][1].dtype)
    known = np.zeros((lanes, steps + width + 1), bool)
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)] = a
        b = b[: steps + band + 1]
        right[k, band + 1 : band + 1 + len(b)] = b  # column j of b stands at j + band
        known[k, band + 1 : band + 1 + len(b)] = True
    slope = np.arange(width, dtype=kind)
    row = np.where((slope >= band) & (slope[None, :] - band <= m[:, None]), slope - kind(band), far).astype(kind)
    out, lane, goal = np.full(lanes, int(far)), np.arange(lanes), m - n + band
    one = kind(1)
    for i in range(1, steps + 1):
        seen = slice(i, i + width)  # b's element i + d for diagonal d = -band..band
        edge = i <= band or i + band > m.min()
        new = row + (right[:, seen] != left[:, i - 1 : i])
        if edge:
            new = np.where(known[:, seen], new, far)
        np.minimum(new[:, :-1], row[:, 1:] + one, out=new[:, :-1])
        if i <= band:
            new[:, band - i] = i  # the column before b's first element
        new -= slope
        np.minimum.accumulate(new, axis=1, out=new)
        new += slope
        if edge:
            new = np.where(known[:, seen] | (slope + (i - band) == 0), np.minimum(new, far), far)
        row = new
        done = n == i
        if done.any():
            at = np.flatnonzero(done & (goal < width))
            out[lane[at]] = row[at, goal[at]]
        if done.any() or i % 16 == 0:
            live = ~done & (row.min(1) <= limits)
            if not live.any():
                break
            if not live.all():
                left, right, known, row, n, m, goal, lane, limits = (x[live] for x in (left, right, known, row, n, m, goal, lane, limits))
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - distance / longer is at least similarity."""
    return distances_within([(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) for a, b in pairs])


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): the least node of each connected component, by minimum labels and pointer jumps.

    Every round is written to the shared folder, so a lost executor costs one round.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = labels.select(F.col("node").alias("n2"), F.col("root").alias("far"))
        new = written(step.join(jump, F.col("low") == F.col("n2"), "left").select("node", F.least("low", F.coalesce("far", "low")).alias("root"), (F.least("low", F.coalesce("far", "low")) != F.col("root")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels


def _sequences(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """key and seq, the shingle hashes cut to 32 bits, of the distinct keys. docs: doc_id, key, text; nodes: key and least, the id of the row to read."""
    keys = written(keys.distinct().join(nodes.select("key", "least"), "key").select(F.col("key").alias("k"), "least"), "keys")
    few = keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    wanted = docs.join(F.broadcast(keys) if few else keys, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")

    def setup():
        def run(texts):
            out = []
            for i, j in byte_slices(texts):
                items, begin = shingles(texts[i:j])
                low = (items >> np.uint64(32)).astype(np.uint32)
                out += [low[p:q].tobytes() for p, q in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            return out

        return run

    # rows equal in id and text are one node
    found = wanted.select("key", per_text(setup, pa.binary(), "text").alias("seq")).groupBy("key").agg(F.first("seq").alias("seq"))
    return written(found, "sequences", compression="none")


def _verify(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar."""
    both = pairs.join(sequences.select(F.col("key").alias("a"), F.col("seq").alias("seq_a")), "a").join(sequences.select(F.col("key").alias("b"), F.col("seq").alias("seq_b")), "b")

    def check(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            good = similar([(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b, strict=True)], similarity)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(check, "a binary, b binary")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def agreeing_across(x: tuple, y: tuple, bucket: int, same: bool):
    """Yield (i, j, n): nodes of blocks x and y in different classes that agree in n >= AGREE samples.

    A block starts with (roots, sketches, crowded), crowded marking the samples whose bucket is. A pair
    comes only from the first crowded bucket that it shares.
    """
    roots, sketch, crowded = x[:3]
    for at in range(0, len(roots), ROWS):
        own = slice(at, at + ROWS)
        n = np.zeros((len(roots[own]), len(y[0])), np.uint8)
        for s in range(SAMPLES):
            n += sketch[own, s, None] == y[1][None, :, s]
        good = (n >= AGREE) & (roots[own, None] != y[0][None]).any(2)
        if same:
            good &= np.arange(at, at + len(n))[:, None] < np.arange(len(y[0]))[None]
        i, j = np.nonzero(good)
        n, i = n[i, j], i + at
        first = ((sketch[i] == y[1][j]) & crowded[i]).argmax(1)
        mine = sketch[i, first] == bucket
        yield i[mine], j[mine], n[mine]


def _labelled(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sequences' elements with their occurrence in the low bits, and the offset of each sequence."""
    sizes = np.array([len(s) for s in sequences])
    items, of = np.concatenate(sequences).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((items, of))
    new = np.concatenate([[True], (np.diff(items[order]) != 0) | (np.diff(of[order]) != 0)])
    index = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = index - np.maximum.accumulate(np.where(new, index, 0))
    return items << np.uint64(32) | occurrence, np.concatenate([[0], np.cumsum(sizes)])


def _held(own: np.ndarray, other: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """How many of own's labels each of n nodes holds; other are the nodes' labels in order, node whose they are."""
    a, b = np.searchsorted(other, own), np.searchsorted(other, own, "right")
    ends, out, at = np.cumsum(b - a), np.zeros(n, np.int64), 0
    while at < len(own):  # no more than about POSTINGS at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, "right")))
        size = b[at:to] - a[at:to]
        stop = np.cumsum(size)
        out += np.bincount(node[np.arange(stop[-1]) + np.repeat(a[at:to] - stop + size, size)], minlength=n)
        at = to
    return out


def links_across(x: tuple, y: tuple, bucket: int, same: bool, similarity: float = SIMILARITY):
    """Links (i, j) between nodes of two blocks, enough to join all classes that have a similar pair here.

    A block is (classes, sketches, crowded, sequences). Every pair that agrees is decided:
    by its lengths and common shingles, which bound the distance, else by alignment,
    those with most in common first, unless links have joined its classes before.
    """
    sizes = [np.array([len(s) for s in b[3]]) for b in (x, y)]
    labels, begin = _labelled(x[3])
    other, other_begin = _labelled(y[3])
    order = np.argsort(other, kind="stable")
    other, node = other[order], np.repeat(np.arange(len(sizes[1])), sizes[1])[order]
    kept: list = []
    for i, j, _ in agreeing_across(x, y, bucket, same):
        longer = np.maximum(sizes[0][i], sizes[1][j])
        limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        near = longer - np.minimum(sizes[0][i], sizes[1][j]) <= limit
        i, j, longer, limit = i[near], j[near], longer[near], limit[near]
        common = np.empty(len(i), np.int64)
        for at, to in zip(*_runs(i)):
            common[at:to] = _held(labels[begin[i[at]] : begin[i[at] + 1]], other, node, len(sizes[1]))[j[at:to]]
        near = longer - common <= limit
        kept.append(np.stack([i[near], j[near], limit[near], (longer - common - limit)[near]]).astype(np.int32))
    i, j, limit, rest = np.concatenate(kept, 1) if kept else np.empty((4, 0), np.int32)
    order = np.argsort(rest, kind="stable")
    i, j, limit = i[order], j[order], limit[order]
    names, inverse = np.unique(np.concatenate([x[0], y[0]]), axis=0, return_inverse=True)
    of = inverse.reshape(-1)
    now, turn = np.arange(len(names)), 1
    a, b = of[i], of[len(x[0]) + j]
    while True:
        apart = now[a] != now[b]
        i, j, limit, a, b = (v[apart] for v in (i, j, limit, a, b))
        if not len(i):
            return
        pair = np.minimum(now[a], now[b]) * len(names) + np.maximum(now[a], now[b])
        order = np.argsort(pair, kind="stable")
        starts, ends = _runs(pair[order])
        chosen = np.zeros(len(i), bool)
        chosen[order[np.arange(len(i)) - np.repeat(starts, ends - starts) < turn]] = True
        at = np.flatnonzero(chosen)
        good = at[distances_within([(x[3][p], y[3][q], int(n)) for p, q, n in zip(i[at], j[at], limit[at], strict=True)])]
        for k in good.tolist():
            one, two = now[a[k]], now[b[k]]
            if one != two:
                now[now == two] = one
                yield int(i[k]), int(j[k])
        i, j, limit, a, b = (v[~chosen] for v in (i, j, limit, a, b))
        turn *= 4


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(x)) if len(x) else starts


def _parts(open_nodes: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """key and part of the nodes (key, root) that may be similar to one of another class; similar ones are in the same part.

    Similar sequences differ by at most a limit in labelled elements, so whatever order elements
    have, the first limit + 1 of both hold a common one. Here those that only one class holds
    come first, then the rarer ones: texts that share a frequent passage and nothing else have
    no common element among them and leave. Nodes with a common one are connected, its classes
    being two; a part is a connected component. Elements of a hot passage are counted map-side.
    """

    def setup():
        return lambda seqs: [_labelled([np.frombuffer(s, np.uint32)])[0].view(np.int64) for s in seqs]

    size = (F.length("seq") / 4).cast("long")
    need = F.floor(F.lit(1 - similarity) * size + 1e-9) + 1 - size
    elements = open_nodes.join(sequences, "key").select("key", F.xxhash64("root").alias("h"), F.xxhash64(F.lit(1), "root").alias("g"), need.alias("need"), F.explode(per_text(setup, pa.list_(pa.int64()), "seq")).alias("e"))
    apart = (F.min("h") != F.max("h")) | (F.min("g") != F.max("g"))
    common = elements.groupBy("e").agg(F.count("*").alias("m"), apart.alias("apart")).where("apart").select("e", "m")
    of_key = W.partitionBy("key")
    firsts = elements.join(common, "e").withColumn("need", F.col("need") + F.count("*").over(of_key)).where("need > 0")
    firsts = firsts.withColumn("at", F.row_number().over(of_key.orderBy("m", "e"))).where("at <= need")
    firsts = written(firsts.select("key", "h", "g", "e"), "firsts")
    stars = firsts.groupBy("e").agg(F.min("key").alias("hub"), apart.alias("apart")).where("apart").select("e", "hub")
    return components(firsts.join(stars, "e").select(F.col("key").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("part"))


def _across(crowd: DataFrame, nodes: DataFrame, roots: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all classes with a similar pair that shares a crowded bucket and agrees in AGREE samples.

    A bucket of one class has none. The nodes of the others go by the parts that can hold similar
    pairs (_parts). What a bucket has of a part is cut into blocks of about BLOCK nodes and
    BLOCK_ITEMS shingles, the largest class apart from the rest, and each block meets each but
    those of the same class in a task of its own, which passes on links alone. crowd: bucket, key.
    """
    crowd = crowd.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = crowd.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("bucket")
    crowd = written(crowd.join(several, "bucket").select("bucket", "key", "root"), "crowd")
    parts = _parts(crowd.select("key", "root").distinct(), sequences, similarity)
    held = crowd.groupBy("key").agg(F.first("root").alias("root"), F.collect_set("bucket").alias("held")).join(parts, "key")
    held = held.join(nodes.select("key", "sketch"), "key").join(sequences, "key")
    held = written(held.select("key", "part", "root", "sketch", "held", "seq"), "held")
    sizes = held.select("part", "root", (F.length("seq") / 4).alias("items"), F.explode("held").alias("bucket")).groupBy("bucket", "part", "root").agg(F.count("*").alias("m"), F.sum("items").alias("items"))
    mixed = sizes.groupBy("bucket", "part").agg(F.count("*").alias("classes"), F.max_by(F.struct("root", "m", "items"), F.struct("m", "root")).alias("top"), F.sum("m").alias("m"), F.sum("items").alias("items")).where("classes > 1")
    cut = lambda m, items: F.ceil(F.greatest(m / F.lit(BLOCK), items / F.lit(BLOCK_ITEMS))).cast("int")
    whole = F.greatest(F.col("m") / BLOCK, F.col("items") / BLOCK_ITEMS) <= 1
    mixed = mixed.select("bucket", "part", F.when(~whole, F.col("top.root")).alias("top"), F.when(whole, 0).otherwise(cut(F.col("top.m"), F.col("top.items"))).alias("tops"), F.when(whole, 1).otherwise(cut(F.col("m") - F.col("top.m"), F.col("items") - F.col("top.items"))).alias("others"))
    # blocks 0 .. others - 1 hold the rest, others .. others + tops - 1 the largest class
    deal = lambda n: F.pmod(F.hash("key", F.lit(3)), n)
    on_top = F.coalesce(F.col("root") == F.col("top"), F.lit(False))
    placed = held.select("key", "part", "root", F.explode("held").alias("bucket")).join(mixed, ["bucket", "part"])
    placed = placed.withColumn("own", F.when(on_top, F.col("others") + deal(F.greatest("tops", F.lit(1)))).otherwise(deal(F.col("others"))))
    meets = F.when(on_top, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("tops") - 1))
    placed = placed.select("key", "bucket", "own", F.explode(meets).alias("meets"))
    node = F.struct((F.col("own") > F.col("meets")).alias("second"), "key", "root", "sketch", F.transform("sketch", lambda x: F.array_contains("held", x)).alias("crowded"), "seq")
    sides = placed.join(held, "key").groupBy("bucket", "part", F.least("own", "meets").alias("x"), F.greatest("own", "meets").alias("y")).agg(F.collect_list(node).alias("nodes"))

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, apart = batch.column(0)[r].as_py(), batch.column(1)[r].as_py() != batch.column(2)[r].as_py()
                nodes: pa.StructArray = batch.column(3)[r].values
                second, keys, roots = (nodes.field(i).to_pylist() for i in (0, 1, 2))
                sketch, crowded = (nodes.field(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, SAMPLES) for i in (3, 4))
                names = np.frombuffer(b"".join(roots), np.uint64).reshape(-1, 2)
                seqs = [np.frombuffer(s, np.uint32) for s in nodes.field(5).to_pylist()]
                side = np.array(second, bool)
                left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if apart else (np.arange(len(keys)),) * 2
                if not len(left) or not len(right):
                    continue
                blocks = [(names[at], sketch[at], crowded[at], [seqs[k] for k in at]) for at in (left, right)]
                found = [sorted((keys[left[i]], keys[right[j]])) for i, j in links_across(*blocks, bucket, not apart, similarity)]
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return sides.select("bucket", "x", "y", "nodes").mapInArrow(compare, "a binary, b binary")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, sketch) and a plan for each text key: group_id, group_size, least and kept_text.

    Exact copies are one node from the start, so a large group of copies costs no pairs.
    Texts without words have no plan.

    In a bucket of up to SMALL nodes all pairs count; in a larger one every node is first
    paired with the bucket's pivot. Then the nodes of larger buckets that are still in
    different classes meet in blocks, where each pair that agrees in AGREE samples is decided.
    So the classes are those of all similar pairs that agree in AGREE samples.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = base.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    light = written(base.select("doc_id", "key", per_text(lambda: sketches, pa.list_(pa.int64()), "text").alias("sketch")), "sketches")
    nodes = written(light.where("sketch is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("sketch").alias("sketch")), "nodes")
    entries = written(nodes.select("key", F.explode("sketch").alias("bucket")), "entries")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    buckets = written(buckets, "buckets")
    shared = written(entries.join(buckets, "bucket").select("bucket", "n", "pivot", "key"), "shared")

    small, crowd = shared.where(F.col("n") <= SMALL), shared.where(F.col("n") > SMALL)
    agreeing = small.groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    agreeing = agreeing.select(F.explode(F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = crowd.where(F.col("key") != F.col("pivot")).select(*_ordered("key", "pivot"))
    counted = agreeing.union(large).groupBy("a", "b").agg(F.count("*").alias("n"))
    tested = written(counted.where(F.col("n") >= AGREE).select("a", "b"), "pairs")
    sequences = _sequences(base.where("key is not null"), nodes, tested.select(F.explode(F.array("a", "b")).alias("key")).union(crowd.select("key")))
    links = written(_verify(tested, sequences, similarity), "links")
    roots = components(links)

    if crowd.limit(1).count():
        more = written(_across(crowd.select("bucket", "key"), nodes, roots, sequences, similarity), "links")
        if more.limit(1).count():
            roots = components(links.union(more))

    of_key = written(nodes.select("key", "least", "rows").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "members")
    of_root = written(of_key.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("m"), F.sum("rows").alias("group_size")).select("root", F.col("m.least").alias("group_id"), F.col("m.key").alias("kept_key"), "group_size"), "groups")
    plan = written(of_key.join(of_root, "root").select("key", "group_id", "group_size", "least", "rows", (F.col("key") == F.col("kept_key")).alias("kept_text")), "plan")
    return light, plan


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (least doc_id of the class), group_size (rows) and keep for every row of docs.

    keep marks one row of each class: its least doc_id, of equal rows one. A null, empty or
    blank text is in no class with others: the row is kept and group_id is its own id. Rows
    with equal ids are rows of their own. Other columns are left out.
    """
    light, plan = classes(docs, doc_id, text, similarity)
    rows = light.select("doc_id", "key")
    hot = plan.where(F.col("rows") > HOT_ROWS)
    if 0 < hot.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        of_hot = rows.join(F.broadcast(hot), "key")
        rows = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(plan.where(F.col("rows") <= HOT_ROWS), "key", "left").unionByName(of_hot)
    else:
        rows = rows.join(plan, "key", "left")
    one = F.row_number().over(W.partitionBy("key", "doc_id").orderBy(F.lit(1))) == 1
    keep = F.col("kept_text") & F.col("doc_id").eqNullSafe(F.col("least")) & one
    worded = F.col("group_size").isNotNull()
    return rows.select("doc_id", F.when(worded, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.when(worded, keep).otherwise(True).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    light, plan = classes(docs, doc_id, text, similarity)
    goes = written(plan.where(~F.col("kept_text")).select("key", F.lit(None).cast(dict(light.dtypes)["doc_id"]).alias("least"), F.lit(True).alias("all")).union(plan.where("kept_text and rows > 1").select("key", "least", F.lit(False).alias("all"))), "goes")
    goes = goes.select(F.col("key").alias("_key"), F.col("least").alias("_least"), F.col("all").alias("_all"))
    few = goes.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    key = F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))
    stays = docs.join(F.broadcast(goes) if few else goes, (key == F.col("_key")) & (F.col("_all") | ~F.col(f"`{doc_id}`").eqNullSafe(F.col("_least"))), "left_anti")
    twice = light.where("sketch is not null").groupBy("key", "doc_id").count().where("count > 1")
    if twice.limit(1).count():  # rows equal in id and text: one of them stays
        order = W.partitionBy(key, F.col(f"`{doc_id}`")).orderBy(F.lit(1))
        blank = key.isNull() | ~F.coalesce(F.col(f"`{text}`").rlike(WORD), F.lit(False))
        stays = stays.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) | blank).drop("_n")
    return stays
