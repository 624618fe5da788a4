"""Column functions: edge differences, kernels, sigmoids, transforms and diversity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def edge_difference(at: Column, of: Column, kind: str = "difference", epsilon: Column | float = 0.0) -> Column:
    """Difference along an edge: `difference` is at - of, `logratio` is log((at + e) / (of + e))."""
    if kind == "difference":
        return at - of
    if kind == "logratio":
        return F.log((at + epsilon) / (of + epsilon))
    raise ValueError(f"no such kind of difference: {kind}")


def sigmoid(x: Column, kind: str = "tanh") -> Column:
    """Odd sigmoids onto (-1, 1)."""
    ways = {"tanh": F.tanh(x), "arctan": F.atan(x) * (2.0 / 3.141592653589793), "algebraic": x / F.sqrt(1 + x * x)}
    return ways[kind]


#: x at which each sigmoid is one half.
HALF = {"tanh": 0.5493061443340549, "arctan": 1.0, "algebraic": 0.5773502691896257}


def kernel(u: Column, kind: str) -> Column:
    """Kernels of a scaled distance; the compact ones are 0 beyond 1."""
    a = F.abs(u)
    inside = {
        "epanechnikov": 0.75 * (1 - u * u),
        "triangular": 1 - a,
        "tricube": F.pow(1 - F.pow(a, 3), 3),
        "biweight": F.pow(1 - u * u, 2),
        "triweight": F.pow(1 - u * u, 3),
        "cosine": 1 + F.cos(a * 3.141592653589793),
        "constant": F.lit(1.0),
    }
    whole = {"normal": F.exp(-u * u / 2), "laplace": F.exp(-a), "cauchy": 1 / (1 + u * u)}
    return whole[kind] if kind in whole else F.when(a < 1, inside[kind]).otherwise(0.0)


def box_cox(x: Column, power: float) -> Column:
    return F.log(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power


def arcsine_sqrt(x: Column) -> Column:
    return F.asin(F.sqrt(x))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def winsorized(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def centred_log_ratio(values: str, pseudo: float = 0.0) -> Column:
    """Array column: log of each part minus the mean log."""
    logs = F.transform(F.col(values), lambda x: F.log(x + F.lit(pseudo)))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.transform(logs, lambda x: x - mean)


def standardised(text: Column) -> Column:
    """A name fit for files: blanks, commas and slashes become underscores, brackets, colons, quotes, stars and pluses go."""
    return F.translate(text, " ,/():'*+", "___")


def entropy(values: str) -> Column:
    """Shannon entropy (natural log) of an array of non-negative parts; 0 parts count nothing, no mass gives 0."""
    total = F.aggregate(F.col(values), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(F.col(values), F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))).otherwise(0.0)


def evenness(values: str) -> Column:
    """Entropy over its largest value for the number of parts; 0 for one part."""
    n = F.size(values)
    return F.when(n > 1, entropy(values) / F.log(n.cast("double"))).otherwise(0.0)
