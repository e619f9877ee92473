"""Vector arithmetic on array columns, in DOUBLE, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(as_double(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scale(a: Column | str, by: Column) -> Column:
    return F.transform(as_double(a), lambda x: x * by)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column | str) -> Column:
    """The vector over its norm; a zero vector stays."""
    return let(as_double(a), lambda x: let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda y: y / n)).otherwise(x)))


def haar(a: Column | str, sign: int = 1) -> Column:
    """One level of the Haar transform: approximation (sign 1) or detail (-1); an odd end repeats its last value."""

    def step(x: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) + 1) / 2).cast("int") - 1))
        return F.transform(pairs, lambda i: (F.element_at(x, i * 2 + 1) + sign * F.element_at(x, F.least(i * 2 + 2, F.size(x)))) / F.sqrt(F.lit(2.0)))

    return let(as_double(a), step)


def haar_pyramid(a: Column | str, levels: int) -> Column:
    """Levels 0 (the vector), 1, ...: approximations, each normalised; stops changing when one value is left."""
    first = F.array(as_double(a))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), first, lambda p, _: F.concat(p, F.array(unit(haar(F.element_at(p, -1)))))) if levels else first


#: Low-pass decomposition filters.
LOW_PASS = {
    "db1": (0.7071067811865476, 0.7071067811865476),
    "db3": (0.03522629188570953, -0.08544127388202666, -0.13501102001025458, 0.45987750211849154, 0.8068915093110925, 0.33267055295008263),
}


def dwt(a: Column | str, wavelet: str = "db3") -> Column:
    """Approximation of one level with symmetric padding; floor((n + filter - 1) / 2) values. For vectors of at least a filter's length."""
    taps = LOW_PASS[wavelet]

    def level(x: Column) -> Column:
        n = F.size(x)

        def value(k: Column) -> Column:
            def term(j: int) -> Column:
                m = 2 * k + 1 - j
                at = F.when(m < 0, -m - 1).when(m >= n, 2 * n - 1 - m).otherwise(m)
                return F.element_at(x, at.cast("int") + 1) * taps[j]

            out = term(0)
            for j in range(1, len(taps)):
                out = out + term(j)
            return out

        return F.transform(F.sequence(F.lit(0), F.floor((n + len(taps) - 1) / 2).cast("int") - 1), value)

    return let(as_double(a), level)


def mean_vector(v: Column | str, at: int) -> Column:
    return F.avg(F.element_at(as_double(v), at))


def mean_of(v: Column | str, size: int) -> Column:
    """Aggregate: element-wise mean of a group's vectors of known size, with partial sums before the shuffle."""
    return F.array(*(mean_vector(v, i + 1) for i in range(size)))
