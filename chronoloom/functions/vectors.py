"""Masked array kernels on columns of arrays of doubles, null where a value is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SCALE = 1e-8


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def total(a: Column) -> Column:
    """The sum of the values there are; null where there are none."""
    return F.when(F.size(present(a)) > 0, _sum(present(a)))


def mean(a: Column) -> Column:
    return F.try_divide(_sum(present(a)), F.size(present(a)))


def bound(value: Column, body) -> Column:
    """body of a value that it needs more than once, worked out once."""
    return F.transform(F.array(value), body)[0]


def std_pop(a: Column) -> Column:
    def spread(z: Column) -> Column:
        return F.sqrt(F.try_divide(_sum(F.transform(z["x"], lambda x: (x - z["m"]) * (x - z["m"]))), F.size(z["x"])))

    return bound(F.struct(present(a).alias("x"), mean(a).alias("m")), spread)


def _level(a: Column) -> Column:
    """The mean m and the population deviation s (1e-8 at least)."""
    return F.struct(mean(a).alias("m"), F.greatest(std_pop(a), F.lit(LEAST_SCALE)).alias("s"))


def normalised(a: Column) -> Column:
    """Instance normalisation: less the mean, by the population deviation (1e-8 at least)."""
    return bound(_level(a), lambda z: F.transform(a, lambda x: (x - z["m"]) / z["s"]))


def rescaled(neighbour: Column, context: Column, query: Column) -> Column:
    """A neighbour's values at the level and scale of a query's context."""
    both = F.struct(_level(context).alias("c"), _level(query).alias("q"))
    return bound(both, lambda z: F.transform(neighbour, lambda x: (x - z["c"]["m"]) / z["c"]["s"] * z["q"]["s"] + z["q"]["m"]))


def distance(a: Column, b: Column, metric: str = "euclidean", least_overlap: float = 0.8) -> Column:
    """Distance over the places where both have a value; null where fewer than the least share have.  One pass over the arrays."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    terms = {"square": lambda x, y: (x - y) * (x - y)} if metric == "euclidean" else {"dot": lambda x, y: x * y, "left": lambda x, y: x * x, "right": lambda x, y: y * y}
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("length"), *[F.lit(0.0).alias(t) for t in terms])

    def add(s: Column, z: Column) -> Column:
        both = z["a"].isNotNull() & z["b"].isNotNull()
        sums = [F.when(both, s[t] + f(z["a"], z["b"])).otherwise(s[t]).alias(t) for t, f in terms.items()]
        return F.struct(F.when(both, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["length"] + 1).alias("length"), *sums)

    def value(s: Column) -> Column:
        if metric == "euclidean":
            found = F.sqrt(s["square"] * s["length"] / F.nullif(s["n"], F.lit(0)))
        else:
            norm = F.sqrt(s["left"]) * F.sqrt(s["right"])
            found = F.when(norm > LEAST_SCALE, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(s["dot"], norm))))
        return F.when(s["n"] >= F.greatest(F.lit(1), F.ceil(s["length"] * least_overlap)), found)

    return F.aggregate(pairs, start, add, value)


def aligned(past: Column, future: Column, context: int, horizon: int) -> Column:
    """The last context values of past, padded with nulls in front, then horizon values of future."""
    tail = F.when(F.size(past) > context, F.slice(past, -context, context)).otherwise(past)
    pad = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), context - F.size(past)))
    return F.concat(pad, tail, F.slice(future, 1, horizon))


def tail(a: Column, origin: Column, length: int) -> Column:
    """The last min(length, origin) values before origin."""
    n = F.least(F.lit(length), origin).cast("int")
    return F.slice(a, (origin - n + 1).cast("int"), n)
