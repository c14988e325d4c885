"""Column expressions: keys, texts, effect sizes and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_P = 1e-300


def symbol(c: Column | str) -> Column:
    """An identifier without blanks around it, in capitals; null for an empty one."""
    s = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(s != "", s)


def first_part(c: str, separator: str) -> Column:
    return F.split_part(F.col(c), F.lit(separator), F.lit(1))


def parts(c: str, separator: str, names: Sequence[str]) -> list[Column]:
    """Columns of the parts of a text, in order; absent parts are empty."""
    return [F.split_part(F.col(c), F.lit(separator), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def composite_key(*columns: str, separator: str = ":") -> Column:
    """The columns as one text, null if one of them is null."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit(separator)] if i else []) + [F.col(c).cast("string")]])


def pair_key(a: str, b: str, separator: str = "_") -> Column:
    """The same text for a pair in either direction."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    return F.concat_ws(separator, F.least(x, y), F.greatest(x, y))


def contains_any(c: str, words: Sequence[str]) -> Column:
    """Whether a text has one of the words, without case; false for null."""
    return F.coalesce(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(F.col(c)), w)), F.lit(False))


def of_family(c: str, prefixes: Sequence[str]) -> Column:
    """Whether a name starts with one of the prefixes and goes on."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (F.startswith(F.col(c), F.lit(p)) & (F.length(c) > len(p)))
    return F.coalesce(out, F.lit(False))


def confidence_interval(c: str) -> tuple[Column, Column]:
    """The bounds of a text such as (0.8-1.2) or (-0.3 - 0.4), signs allowed."""
    number = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
    pattern = rf"\(?\s*({number})\s*(?:-|to|,)\s*({number})\s*\)?"
    return tuple(F.regexp_extract(F.col(c), pattern, i).try_cast("double") for i in (1, 2))


def odds_ratio(beta: str, se: str, z: float = 1.96) -> list[Column]:
    b, s = F.col(beta), F.col(se)
    return [F.exp(b).alias("odds_ratio"), F.exp(b - z * s).alias("ci_low"), F.exp(b + z * s).alias("ci_high")]


def signed_log_p(p: str, effect: str) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(LEAST_P))) * F.signum(effect)


def weighted_log_p(p: str, effect: str) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(LEAST_P))) * F.col(effect)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def twice_the_lesser(a: str, b: str) -> Column:
    """z1 + z2 - |z1 - z2|: high only where both are."""
    return F.col(a) + F.col(b) - F.abs(F.col(a) - F.col(b))


def flags(separator: str = "|", **rules: Column) -> Column:
    """The names of the rules that hold, in order, or OK."""
    named = F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]))
    return F.when(F.size(named) == 0, F.lit("OK")).otherwise(F.array_join(named, separator))


def formatted(c: str, digits: int = 3, missing: str = "NA") -> Column:
    return F.coalesce(F.format_number(F.col(c), digits), F.lit(missing))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str, b: str) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def protein_features(sequence: str) -> list[Column]:
    """Length, shares of the residue classes and net charge at neutral pH from counts."""
    s = F.upper(sequence)
    share = lambda letters: F.try_divide(F.regexp_count(s, F.lit(f"[{letters}]")), F.length(s))
    charge = F.regexp_count(s, F.lit("[KR]")) - F.regexp_count(s, F.lit("[DE]"))
    return [F.length(s).alias("n_residues"), share("AVILMFWC").alias("hydrophobic"), share("STNQYGP").alias("polar"), share("KRH").alias("basic"), share("DE").alias("acidic"), share("FWY").alias("aromatic"), charge.alias("net_charge")]


# Mass of the residues' amino acids, their hydropathy (Kyte and Doolittle), pK of the charged ones.
RESIDUE_MASS = {"A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.15, "E": 147.13, "Q": 146.15, "G": 75.07, "H": 155.16, "I": 131.17, "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15}
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
ACID_PK, BASE_PK = {"D": 3.9, "E": 4.3, "C": 8.3, "Y": 10.1}, {"K": 10.5, "R": 12.5, "H": 6.0}
WATER = 18.015


def protein_profile(sequence: str) -> list[Column]:
    """log_length (ln(1 + n)), kilodalton, isoelectric, hydropathy, aromatic, and share_<residue> of each of the 20 residues.

    The mass counts known residues less a water for each bond; the isoelectric point halves 0 to
    14 fifty times on the charges of side chains. Other letters count in the length only. An
    empty or null sequence has 0 everywhere.
    """
    s = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    n = F.length(s)
    counts = {r: n - F.length(F.translate(s, r, "")) for r in RESIDUE_MASS}
    ten = lambda x: F.pow(F.lit(10.0), x)

    # the counts go along with the span: as expressions of the text they would be counted anew in every step
    charged = [*BASE_PK, *ACID_PK]

    def charge(span: Column, ph: Column) -> Column:
        positive = sum((span[r] / (1 + ten(ph - pk)) for r, pk in BASE_PK.items()), F.lit(0.0))
        return positive - sum((span[r] / (1 + ten(F.lit(pk) - ph)) for r, pk in ACID_PK.items()), F.lit(0.0))

    def halve(span: Column, _: Column) -> Column:
        middle = (span["low"] + span["high"]) / 2
        up = charge(span, middle) > 0
        return F.struct(F.when(up, middle).otherwise(span["low"]).alias("low"), F.when(up, span["high"]).otherwise(middle).alias("high"), *[span[r].alias(r) for r in charged])

    point = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), *[counts[r].alias(r) for r in charged]), halve, lambda span: (span["low"] + span["high"]) / 2)
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    share = lambda letters: some(sum((counts[r] for r in letters), F.lit(0)) / n)
    mass = sum((counts[r] * w for r, w in RESIDUE_MASS.items()), F.lit(0.0)) - (n - 1) * WATER
    water = sum((counts[r] * w for r, w in HYDROPATHY.items()), F.lit(0.0)) / n
    return [F.log1p(n).alias("log_length"), some(mass / 1000).alias("kilodalton"), some(point).alias("isoelectric"), some(water).alias("hydropathy"), share("FYW").alias("aromatic"), *[share(r).alias(f"share_{r}") for r in sorted(RESIDUE_MASS)]]


def complement(allele: Column) -> Column:
    """The allele on the other strand."""
    return F.translate(F.upper(allele), "ACGT", "TGCA")


def overridden(default: Column, rules: Sequence[tuple[Column, object]]) -> Column:
    """The value of the last rule that holds: updates one after another, each over those before."""
    out = None
    for condition, value in reversed(rules):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)
