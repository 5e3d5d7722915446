"""Column expressions over one structure: ARRAY<STRUCT<z, px, py, pz, q>> atoms, all folded left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.vectors import fold_sum

ATOMS = "array<struct<z:int,px:double,py:double,pz:double,q:double>>"


def formula(atoms: Column) -> Column:
    """Counts by element, as 1x2_8x1."""
    z = F.transform(atoms, lambda a: a["z"])
    count = lambda e: F.size(F.filter(z, lambda v: v == e))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(z)), lambda e: F.concat_ws("x", e.cast("string"), count(e).cast("string"))), "_")


def within(atoms: Column, allowed: list[int]) -> Column:
    """Whether every element is allowed."""
    return F.size(F.array_except(F.transform(atoms, lambda a: a["z"]), F.array(*map(F.lit, allowed)))) == 0


def charges_usable(atoms: Column) -> Column:
    q = F.transform(atoms, lambda a: a["q"])
    return (F.size(q) > 0) & ~F.exists(q, lambda v: v.isNull() | F.isnan(v))


def mean_of(values: Column) -> Column:
    return fold_sum(values) / F.size(values)


def _axis(atoms: Column, name: str) -> Column:
    return F.transform(atoms, lambda a: a[name])


def _about_mean(atoms: Column, name: str, value) -> Column:
    """Values of value(atom, coordinate less its mean)."""
    both = F.array(F.struct(atoms.alias("a"), mean_of(_axis(atoms, name)).alias("m")))
    return F.transform(both, lambda s: F.transform(s["a"], lambda a: value(a, a[name] - s["m"])))[0]


def gyration(atoms: Column) -> Column:
    """Root mean squared distance from the centroid."""
    x, y, z = (mean_of(_about_mean(atoms, c, lambda a, d: d * d)) for c in ("px", "py", "pz"))
    return F.sqrt(x + y + z)


def dipole(atoms: Column) -> Column:
    """Norm of the charge-weighted positions about the centroid."""
    x, y, z = (fold_sum(_about_mean(atoms, c, lambda a, d: a["q"] * d)) for c in ("px", "py", "pz"))
    return F.sqrt(x * x + y * y + z * z)


def quadrupole(atoms: Column) -> Column:
    """Norm of the traceless charge-weighted second moments about the centroid, for each atom."""
    centre = F.struct(atoms.alias("a"), *(mean_of(_axis(atoms, c)).alias(c) for c in ("px", "py", "pz")))

    def entry(s: Column, u: str, v: str) -> Column:
        def one(a: Column) -> Column:
            x, y, z = (a[c] - s[c] for c in ("px", "py", "pz"))
            p, r = {"px": x, "py": y, "pz": z}[u], {"px": x, "py": y, "pz": z}[v]
            return a["q"] * (3 * p * r - (x * x + y * y + z * z if u == v else F.lit(0.0)))

        return fold_sum(F.transform(s["a"], one))

    def size(s: Column) -> Column:
        square = lambda u, v: F.pow(entry(s, u, v), 2)
        diagonal = square("px", "px") + square("py", "py") + square("pz", "pz")
        return F.sqrt(diagonal + 2 * (square("px", "py") + square("px", "pz") + square("py", "pz"))) / F.size(s["a"])

    return F.transform(F.array(centre), size)[0]


def norm_summary(vectors: Column) -> dict[str, Column]:
    """Largest and root mean squared norm of an array of vectors."""
    squares = F.transform(vectors, lambda v: fold_sum(F.transform(v, lambda x: x * x)))
    return {"fmax": F.sqrt(F.array_max(squares)), "frms": F.sqrt(mean_of(squares))}


def charge_summary(atoms: Column) -> dict[str, Column]:
    q = F.transform(atoms, lambda a: a["q"])
    return {"q_min": F.array_min(q), "q_max": F.array_max(q), "q_rms": F.sqrt(mean_of(F.transform(q, lambda v: v * v)))}


def coulomb(atoms: Column, cut: float) -> tuple[Column, Column]:
    """Sums of q_i q_j / r over pairs, all and nearer than the cut, divided by the number of atoms; r at least 1e-6."""
    each = F.flatten(F.transform(atoms, lambda a, i: F.transform(F.slice(atoms, i + 2, F.size(atoms)), lambda b: F.struct((a["q"] * b["q"]).alias("qq"), distance(a, b).alias("r")))))
    value = lambda p: p["qq"] / F.greatest(p["r"], F.lit(1e-6))
    return fold_sum(F.transform(each, value)) / F.size(atoms), fold_sum(F.transform(F.filter(each, lambda p: p["r"] < cut), value)) / F.size(atoms)


def distance(a: Column, b: Column) -> Column:
    d = lambda c: (a[c] - b[c]) * (a[c] - b[c])
    return F.sqrt(d("px") + d("py") + d("pz"))


def element_charges(atoms: Column, element: int) -> tuple[Column, Column]:
    """Mean and population deviation of the charges of an element; 0 without one."""
    q = F.transform(F.filter(atoms, lambda a: a["z"] == element), lambda a: a["q"])
    none = F.size(q) == 0
    mean = F.when(none, F.lit(0.0)).otherwise(fold_sum(q) / F.size(q))
    square = F.when(none, F.lit(0.0)).otherwise(fold_sum(F.transform(q, lambda v: v * v)) / F.size(q))
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def broadened(values: Column, centres: list[float], width: float) -> Column:
    """Gaussian-broadened histogram of values at the centres."""
    return F.transform(F.array(*map(F.lit, centres)), lambda c: fold_sum(F.transform(values, lambda v: F.exp(-(v - c) * (v - c) / (2 * width * width)))))


def binned_shares(values: Column, low: float, width: float, bins: int) -> Column:
    """Shares of values by bin, the last bin holding the overflow; zeros without values. The values are computed once, not for each bin."""
    bin_ = F.transform(values, lambda v: F.least(F.floor((v - low) / width), F.lit(bins - 1)))
    share = lambda held, k: F.size(F.filter(held, lambda b: b == k)) / F.greatest(F.size(held), F.lit(1))
    shares = lambda held: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: share(held, k))
    return F.get(F.transform(F.array(bin_), shares), F.lit(0))
