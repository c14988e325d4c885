"""Pleiotropy residual sum and outliers: simulated residuals of instruments for many exposures at once.

Draws are hashes of seed, group, variant and replicate, so every pass and every rerun sees the same
ones and nothing that is drawn is stored. Tasks draw whole blocks of variants and replicates in
numpy. A group of up to WHOLE variants is one piece; larger ones are dealt to pieces, whose sums
are added between two passes, so no task holds more than one piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import held, reach_package

#: Variants of a group that one task simulates.
WHOLE = 32_768
#: Variants a task takes in all; replicates make each of them a thousand rows' work.
VARIANTS_A_TASK = 20_000
#: Draws at a time: what is worked out in the processor's cache.
BLOCK = 32_768


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def _normals(seed: int, key: Column, replicate: Column) -> tuple[Column, Column]:
    """Two independent normal draws of a variant and replicate, by the polar form of Box and Muller."""
    u, v = (uniform(F.lit(seed), F.lit(k), key, replicate) for k in (1, 2))
    r = F.sqrt(-2 * F.ln(u))
    return r * F.cos(v * 6.283185307179586), r * F.sin(v * 6.283185307179586)


def observed(df: DataFrame, groups: Sequence[str], snp: Sequence[str], least: int = 4) -> DataFrame:
    """groups, snp, x, y, sx, sy, w, n_snp, beta, rest, gap2, key: rest is the inverse-variance slope without the variant, gap2 = (y - rest x)^2.

    Exposures are turned positive. Groups with fewer than least complete variants, or a null in
    groups, are left out, as are variants with a standard error not above 0.
    """
    sign = F.when(F.col("beta") < 0, -1.0).otherwise(1.0)
    d = df.na.drop(subset=[*groups, "beta", "beta_out", "se", "se_out"]).where("se > 0 and se_out > 0")
    d = d.select(*groups, *snp, (F.col("beta") * sign).alias("x"), (F.col("beta_out") * sign).alias("y"), F.col("se").alias("sx"), F.col("se_out").alias("sy"), (1 / (F.col("se_out") * F.col("se_out"))).alias("w"), F.xxhash64(*groups, *snp).alias("key"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    totals = d.groupBy(*groups).agg(F.count("*").alias("n_snp"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy")).where(F.col("n_snp") >= least)
    both = d.join(totals, list(groups)).withColumn("beta", F.try_divide("_xy", "_xx")).withColumn("rest", F.try_divide(F.col("_xy") - w * x * y, F.col("_xx") - w * x * x))
    return both.withColumn("gap2", F.pow(y - F.col("rest") * x, F.lit(2.0))).drop("_xx", "_xy")


def residual_sums(df: DataFrame, groups: Sequence[str], snp: Sequence[str], least: int = 4) -> DataFrame:
    """groups, n_snp, beta, rss: the weighted sum of squared residuals, each from the slope without its variant."""
    o = observed(df, groups, snp, least)
    return o.groupBy(*groups).agg(F.first("n_snp").alias("n_snp"), F.first("beta").alias("beta"), F.sum(F.col("w") * F.col("gap2")).alias("rss"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _hash_int(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return _mix(_turn((seed + (_P5 + np.uint64(4))) ^ (v.astype(np.uint32).astype(np.uint64) * _P1), 23) * _P2 + _P3)


def _hash_long(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return _mix(_turn((seed + (_P5 + np.uint64(8))) ^ (_turn(v.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)


#: The lower bits of a hash that make a number in (0, 1), and those of them beyond the steps of the table of a turn.
_LOW, _REST = np.uint64((1 << 53) - 1), np.uint64((1 << 43) - 1)
_UNIT = 2 * np.pi / float(1 << 53)
#: Square root of 2 times cosine and sine of each step's start and half a unit.
_COS, _SIN = (np.sqrt(2) * f(np.arange(1024) * (2 * np.pi / 1024) + _UNIT / 2) for f in (np.cos, np.sin))
#: Cells of (0, 1) whose Poisson number is looked up, by the leading bits.
CELLS = 12


def _begun(seed: int, k: int, key: np.ndarray) -> np.ndarray:
    """The hash of seed, k and each key, up to where the replicate comes in."""
    with np.errstate(over="ignore"):
        start = _hash_int(np.array([k]), _hash_int(np.array([seed]), np.array([42], np.uint64)))
        return _turn(_hash_long(key, start) + (_P5 + np.uint64(4)), 23)


def _rounds(replicates: int) -> np.ndarray:
    return _turn(np.arange(1, replicates + 1, dtype=np.uint64) * _P1, 23)


def _bits(begun: np.ndarray, rounds: np.ndarray, h: np.ndarray, spare: np.ndarray) -> None:
    """h: Spark's xxhash64 of each key (rows) and replicate (columns)."""
    np.bitwise_xor(begun[:, None], rounds, out=h)
    np.multiply(h, _P2, out=h)
    np.add(h, _P3, out=h)
    for by, times in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(h, np.uint64(by), out=spare)
        np.bitwise_xor(h, spare, out=h)
        if times is not None:
            np.multiply(h, times, out=h)


def _uniform(h: np.ndarray) -> np.ndarray:
    """The numbers in (0, 1) that the lower 53 bits make."""
    return ((h & _LOW).astype(float) + 0.5) / float(1 << 53)


def _lengths(h: np.ndarray, spare: np.ndarray, out: np.ndarray) -> None:
    """out: the root of minus the logarithm of the numbers in (0, 1) that the lower 53 bits make."""
    np.bitwise_and(h, _LOW, out=spare)
    np.copyto(out, spare.view(np.int64), casting="unsafe")
    out += 0.5
    np.divide(float(1 << 53), out, out=out)
    np.log(out, out=out)
    np.sqrt(out, out=out)


def _circle(h: np.ndarray, spare: np.ndarray, cos: np.ndarray, sin: np.ndarray, room: Sequence[np.ndarray]) -> None:
    """cos and sin, times the root of 2, of the turns that the lower 53 bits make: ten of them are looked up, the series of the rest end below 1e-16."""
    # take copies what does not lie in rows
    h, spare, cos, sin, c, s, b, square = (a.ravel("K") for a in (h, spare, cos, sin, *room))
    np.right_shift(h, np.uint64(43), out=spare)
    np.bitwise_and(spare, np.uint64(1023), out=spare)
    # clip: nor is the result copied then; ten bits are always within the table
    np.take(_COS, spare.view(np.int64), out=cos, mode="clip")
    np.take(_SIN, spare.view(np.int64), out=sin, mode="clip")
    np.bitwise_and(h, _REST, out=h)
    np.copyto(b, h.view(np.int64), casting="unsafe")
    np.multiply(b, b, out=square)
    np.multiply(square, _UNIT**5 / 120, out=s)
    s -= _UNIT**3 / 6
    s *= square
    s += _UNIT
    s *= b
    np.multiply(square, _UNIT**4 / 24, out=c)
    c -= _UNIT**2 / 2
    c *= square
    c += 1
    np.multiply(cos, s, out=b)
    np.multiply(sin, s, out=s)
    cos *= c
    cos -= s
    sin *= c
    sin += b


def uniforms(seed: int, k: int, key: np.ndarray, replicates: int) -> np.ndarray:
    """uniform(seed, k, key, r) of each key (rows) and r from 1 to replicates (columns): Spark's xxhash64 in numpy."""
    h, spare = np.empty((2, len(key), replicates), np.uint64)
    _bits(_begun(seed, k, key), _rounds(replicates), h, spare)
    return _uniform(h)


@functools.lru_cache(1)
def _room(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays that all blocks of a process are worked out in: new ones would cost more than the work."""
    return np.empty((2, size), np.uint64), np.empty((6, size))


def _blocks(n: int, replicates: int) -> Iterator[tuple[slice, list[np.ndarray], list[np.ndarray]]]:
    """Slices of the replicates, each with two arrays of whole numbers and six of doubles for n variants (rows) and those replicates (columns)."""
    step = max(1, BLOCK // max(1, n))
    whole, real = _room(max(BLOCK, n))
    for i in range(0, replicates, step):
        m = min(step, replicates - i)
        # the longer side lies together in memory
        shaped = [[(a[: n * m].reshape(n, m) if m > n else a[: n * m].reshape(m, n).T) for a in arrays] for arrays in (whole, real)]
        yield slice(i, i + m), *shaped


class _Piece:
    """Variants of one group as arrays; each block of replicates is drawn and used up before the next one.

    Effects are in units of their outcome's standard error (w is its square's inverse), so weights are 1.
    """

    def __init__(self, table: pa.Table, replicates: int, seed: int):
        self.key = table["key"].to_numpy()
        x, sx, sy, rest, gap2 = (table[c].to_numpy().astype(float) for c in ("x", "sx", "sy", "rest", "gap2"))
        self.x, self.sx, self.y, self.gap2 = x / sy, sx / sy, rest * x / sy, gap2 / (sy * sy)
        self.replicates, self.rounds = replicates, _rounds(replicates)
        self.begun = [_begun(seed, k, self.key) for k in (1, 2)]

    def _draws(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Exposure and outcome effects of each block, by the polar form of Box and Muller."""
        for b, (h, spare), (dx, dy, r, *room) in _blocks(len(self.key), self.replicates):
            _bits(self.begun[0], self.rounds[b], h, spare)
            _lengths(h, spare, r)
            _bits(self.begun[1], self.rounds[b], h, spare)
            # spare is read before it is used as doubles
            _circle(h, spare, dx, dy, [*room, spare.view(float)])
            dx *= r
            dx *= self.sx[:, None]
            dx += self.x[:, None]
            dy *= r
            dy += self.y[:, None]
            yield b, dx, dy, [r, *room]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums of dx dx and dx dy of each replicate."""
        xx, xy = np.empty((2, self.replicates))
        for b, dx, dy, (square, *_) in self._draws():
            xx[b] = np.multiply(dx, dx, out=square).sum(0)
            xy[b] = np.multiply(dx, dy, out=square).sum(0)
        return xx, xy

    def beyond(self, xx: np.ndarray | None = None, xy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The residual sum of each replicate, and how often each variant's squared residual is above the observed one; a group in pieces needs its sums."""
        rss, above = np.empty(self.replicates), np.zeros(len(self.key), np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            for b, dx, dy, (below, gap2, *_) in self._draws():
                np.multiply(dx, dx, out=below)
                np.multiply(dx, dy, out=gap2)
                np.subtract(below.sum(0) if xx is None else xx[b], below, out=below)
                np.subtract(gap2.sum(0) if xy is None else xy[b], gap2, out=gap2)
                gap2 /= below
                gap2 *= dx
                np.subtract(dy, gap2, out=gap2)
                gap2 *= gap2
                rss[b] = gap2.sum(0)
                if not np.isfinite(rss[b]).all():  # a slope that divides by 0 counts for nothing
                    gap2[below == 0] = np.nan
                    rss[b] = np.nansum(gap2, 0)
                # a block has fewer replicates than 65,536
                above += np.add.reduce((gap2 > self.gap2[:, None]).view(np.uint8), axis=1, dtype=np.uint16)
        return rss, above


def _redraw(table: pa.Table, out: np.ndarray, rate: float, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of w x x and w x y of each replicate, with outliers once and every other variant a Poisson number of times with mean rate."""
    x, y, w = (table[c].to_numpy().astype(float) for c in "xyw")
    products, rounds = np.array([w * x * x, w * x * y]), _rounds(replicates)
    once, products = products[:, out].sum(1), np.ascontiguousarray(products[:, ~out])
    begun = _begun(seed, 3, table["key"].to_numpy()[~out])
    chance = [np.exp(-rate)]
    for k in range(1, 16):
        chance.append(chance[-1] * rate / k)
    within, sums = np.cumsum(chance), np.empty((2, replicates))
    first, last = (_uniform((np.arange(1 << CELLS, dtype=np.uint64) << np.uint64(53 - CELLS)) + np.uint64(i)) for i in (0, (1 << (53 - CELLS)) - 1))
    cells, ends = (np.searchsorted(within, u) for u in (first, last))
    cells = np.where(cells == ends, cells, -1).astype(np.int8)
    for b, (h, spare), (times, *_) in _blocks(len(begun), replicates):
        _bits(begun, rounds[b], h, spare)
        flat, number = h.ravel("K"), times.ravel("K")
        at = spare.ravel("K")
        np.right_shift(flat, np.uint64(53 - CELLS), out=at)
        np.bitwise_and(at, np.uint64((1 << CELLS) - 1), out=at)
        count = np.take(cells, at.view(np.int64), mode="clip")
        unsure = np.flatnonzero(count < 0)
        count[unsure] = np.searchsorted(within, _uniform(flat[unsure]))
        np.copyto(number, count)
        sums[:, b] = products @ times
    return tuple(sums + once[:, None])


def _distorted(table: pa.Table, above: np.ndarray, replicates: int, level: float, seed: int) -> int | None:
    """In how many replicates the estimate of a whole group moves further than it does without its outliers; none if no or every variant is one."""
    n, (x, y, w) = len(above), (table[c].to_numpy().astype(float) for c in "xyw")
    out, xx, xy = np.minimum(1.0, above / replicates * n) <= level, w * x * x, w * x * y
    k = int(out.sum())
    if not 0 < k < n or xx[~out].sum() == 0:
        return None
    kept, every = xy[~out].sum() / xx[~out].sum(), xy.sum() / xx.sum()
    if kept == 0:
        return 0
    with np.errstate(divide="ignore", invalid="ignore"):
        sums, products = _redraw(table, out, max(0.0, (n - 2 * k) / (n - k)), replicates, seed)
        estimates = np.where((sums == 0) | (products == 0), np.nan, products / sums)
        return int((np.abs((every - estimates) / np.abs(estimates)) > abs((every - kept) / abs(kept))).sum())


def _added(c: str) -> Column:
    """The arrays of a group's pieces, added up place by place."""
    arrays = F.collect_list(c)
    return F.aggregate(F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))), F.element_at(arrays, 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def _firsts(table: pa.Table, names: Sequence[str]) -> dict:
    return {c: table[c].slice(0, 1) for c in names}


def _dealt(o: DataFrame, by: Sequence[str]) -> DataFrame:
    return o.repartition(int(max(o.sparkSession.sparkContext.defaultParallelism, 1 + o.count() // VARIANTS_A_TASK)), *by)


def _simulated(o: DataFrame, groups: Sequence[str], replicates: int, level: float, seed: int) -> DataFrame:
    """o's variants with above (how many simulated squared residuals are above the observed one), wins (how many residual sums of the group are) and, for significant groups in one piece, distorted."""
    reach_package(o.sparkSession)
    keys, pieces = list(groups), F.ceil(F.col("n_snp") / WHOLE)
    left = [f for f in o.schema.fields if f.name not in ("sx", "sy", "rest")]
    above_schema = T.StructType([*left, T.StructField("above", T.LongType())])
    whole_schema = T.StructType([*above_schema.fields, T.StructField("wins", T.LongType()), T.StructField("distorted", T.LongType())])
    doubles, longs = pa.list_(pa.float64()), pa.int64()

    def whole(table: pa.Table) -> pa.Table:
        piece = _Piece(table, replicates, seed)
        rss, above = piece.beyond()
        wins = int((rss > piece.gap2.sum()).sum())
        distorted = _distorted(table, above, replicates, level, seed) if wins / replicates < level else None
        table = table.select([f.name for f in left]).append_column("above", pa.array(above, longs))
        return table.append_column("wins", pa.array([wins] * len(above), longs)).append_column("distorted", pa.array([distorted] * len(above), longs))

    small = _dealt(o.where(pieces == 1), keys).groupBy(*keys).applyInArrow(whole, whole_schema)
    big = o.where(pieces > 1)
    if not big.limit(1).count():
        return small

    def sums(table: pa.Table) -> pa.Table:
        xx, xy = _Piece(table, replicates, seed).sums()
        return pa.table(_firsts(table, [*keys, "piece"]) | {"xx": pa.array([xx], doubles), "xy": pa.array([xy], doubles)})

    def second(table: pa.Table, totals: pa.Table) -> pa.Table:
        xx, xy = (np.array(totals[c][0].as_py()) for c in ("xx", "xy"))
        rss, above = _Piece(table, replicates, seed).beyond(xx, xy)
        table = table.select([*[f.name for f in left], "piece"]).append_column("above", pa.array(above, longs))
        return table.append_column("rss", pa.array([rss, *[None] * (len(above) - 1)], doubles))

    of_keys = [o.schema[k] for k in keys]
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xx", "xy")]
    parts = _dealt(big.withColumn("piece", F.pmod("key", pieces)), [*keys, "piece"])
    totals = held(parts.groupBy(*keys, "piece").applyInArrow(sums, T.StructType([*of_keys, T.StructField("piece", T.LongType()), *arrays])).groupBy(*keys).agg(F.collect_list("piece").alias("pieces"), _added("xx").alias("xx"), _added("xy").alias("xy")), "presso-sums")
    spread = totals.select(*keys, F.explode("pieces").alias("piece"), "xx", "xy")
    tagged = T.StructType([*left, T.StructField("piece", T.LongType()), T.StructField("above", T.LongType()), T.StructField("rss", T.ArrayType(T.DoubleType()))])
    both = held(parts.groupBy(*keys, "piece").cogroup(spread.groupBy(*keys, "piece")).applyInArrow(second, tagged), "presso-pieces")
    null = both.where("rss is not null").groupBy(*keys).agg(_added("rss").alias("rss")).join(big.groupBy(*keys).agg(F.sum(F.col("w") * F.col("gap2")).alias("own")), keys)
    wins = null.select(*keys, F.size(F.filter("rss", lambda v: v > F.col("own"))).cast("long").alias("wins"))
    return small.unionByName(both.drop("piece", "rss").join(wins, keys).withColumn("distorted", F.lit(None).cast("long")))


def _redrawn(marked: DataFrame, groups: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """groups, estimates of groups in pieces: of each replicate, with outliers once and every other variant a Poisson number of times with the mean rate."""
    reach_package(marked.sparkSession)
    keys = list(groups)

    def sums(table: pa.Table) -> pa.Table:
        xx, xy = _redraw(table, table["outlier"].to_numpy(), table["rate"][0].as_py(), replicates, seed)
        return pa.table(_firsts(table, keys) | {"xx": pa.array([xx], pa.list_(pa.float64())), "xy": pa.array([xy], pa.list_(pa.float64()))})

    schema = T.StructType([*[marked.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xx", "xy")]])
    parts = _dealt(held(marked.withColumn("piece", F.pmod("key", F.ceil(F.col("n_snp") / WHOLE))), "presso-marked"), [*keys, "piece"])
    total = parts.groupBy(*keys, "piece").applyInArrow(sums, schema).groupBy(*keys).agg(_added("xx").alias("xx"), _added("xy").alias("xy"))
    return total.select(*keys, F.zip_with("xy", "xx", lambda a, c: F.try_divide(a, c)).alias("estimates"))


def presso(df: DataFrame, groups: Sequence[str], snp: Sequence[str], replicates: int = 1000, level: float = 0.05, seed: int = 42, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(results, variants) of harmonised rows (beta, se, beta_out, se_out).

    results: groups, n_snp, beta, rss, p (share of the simulated residual sums above the observed
    one), n_outliers, beta_corrected (without outliers), distortion and distortion_p. variants:
    groups, snp, gap2, p, outlier, for groups whose p is below level; there p is the share of
    simulated squared residuals above the observed one, times n_snp, at most 1.

    In a replicate each exposure effect is drawn about its own value, each outcome effect about
    the one that the slope without the variant predicts, and the residuals are taken from the
    replicate's slopes without each variant. The distortion is the move of the estimate, relative
    to the corrected one; its null takes the outliers and, of the n - k others, as many as make
    n - k together, with replacement: here each other stands a Poisson number of times with that
    mean. beta_corrected and the distortion are null where no or every variant is an outlier.
    """
    keys = list(groups)
    # sums of groups and their variants come from the same rows, which are often the end of a long plan
    rows = held(df.select(*keys, *snp, "beta", "se", "beta_out", "se_out"), "presso-rows")
    o = held(observed(rows, groups, snp, least), "presso-variants")
    share = lambda c: F.col(c) / F.lit(float(replicates))
    tested = held(_simulated(o, groups, replicates, level, seed), "presso-tested").withColumn("global_p", share("wins"))
    tested = tested.withColumn("p", F.least(F.lit(1.0), share("above") * F.col("n_snp"))).withColumn("outlier", (F.col("global_p") < level) & (F.col("p") <= level))

    x, y, w = F.col("x"), F.col("y"), F.col("w")
    xx, xy = w * x * x, w * x * y
    of_group = [F.first(c).alias(c) for c in ("n_snp", "beta", "global_p", "distorted")]
    sums = tested.groupBy(*keys).agg(*of_group, F.sum(w * F.col("gap2")).alias("rss"), F.count_if("outlier").alias("n_outliers"), F.sum(F.when(~F.col("outlier"), xx)).alias("_xx"), F.sum(F.when(~F.col("outlier"), xy)).alias("_xy"), F.sum(xx).alias("_axx"), F.sum(xy).alias("_axy"))
    kept = F.when((F.col("n_outliers") > 0) & (F.col("n_outliers") < F.col("n_snp")), F.try_divide("_xy", "_xx"))
    bias = lambda b: F.try_divide(F.col("_all") - b, F.abs(b))
    corrected = bias(F.col("beta_corrected"))
    out = sums.withColumn("beta_corrected", kept).withColumn("_all", F.try_divide("_axy", "_axx"))

    in_pieces = F.col("n_snp") > WHOLE
    if o.where(in_pieces).limit(1).count():
        out = held(out, "presso-corrected")
        rate = F.greatest(F.lit(0.0), (F.col("n_snp") - 2 * F.col("n_outliers")) / (F.col("n_snp") - F.col("n_outliers")))
        torn = out.where(in_pieces & F.col("beta_corrected").isNotNull())
        drawn = _redrawn(tested.join(torn.select(*keys, rate.alias("rate")), keys), groups, replicates, seed)
        more = F.filter("estimates", lambda b: F.abs(bias(b)) > F.abs(corrected))
        beyond = drawn.join(torn, keys).select(*keys, F.size(more).alias("_more"))
        out = out.join(beyond, keys, "left").withColumn("distorted", F.coalesce("distorted", "_more"))
    out = out.select(*keys, "n_snp", "beta", "rss", F.col("global_p").alias("p"), "n_outliers", "beta_corrected", corrected.alias("distortion"), share("distorted").alias("distortion_p"))
    return out, tested.where(F.col("global_p") < level).select(*keys, *snp, "gap2", "p", "outlier")
