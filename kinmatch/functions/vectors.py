"""Vector expressions in double precision, summed in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def squared_norm(a: Column) -> Column:
    return F.aggregate(
        a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )


#: Squared lengths whose products neither overflow nor vanish; other vectors are scaled first.
ORDINARY = (1e-150, 1e150)


def largest(a: Column) -> Column:
    """The largest absolute value; NaN counts as larger than infinity."""
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def directed(a: Column) -> Column:
    """Whether a vector points somewhere: all values are finite and one isn't zero."""
    return let(largest(a), lambda m: F.coalesce((m > 0) & (m < F.lit(float("inf"))), F.lit(False)))


def scaled(a: Column) -> Column:
    """A directed vector in doubles, shortened or stretched by a power of two, which is exact."""
    def by(top):
        power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(top)).cast("double")))
        return F.transform(a, lambda x: x.cast("double") * F.pow(F.lit(2.0), -power))

    return let(largest(a), by)


def cosine_distance(a: Column, b: Column, squared_norm_b: Column | None = None) -> Column:
    """1 - cosine; NaN when a vector isn't ``directed``, so such rows sort last.

    Vectors whose squared length would overflow or vanish are scaled first. Give
    ``squared_norm_b`` when it is known, as for one query against many rows; then ``b`` is
    taken as it is and must be of an ordinary length.
    """
    nan = F.lit(float("nan"))

    def distance(v, w, squared):
        def clipped(raw):
            cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
            return F.when(F.isnan(raw), nan).otherwise(1.0 - cosine)

        return let(dot(v, w) / F.sqrt(squared), clipped)

    def between(v, w, norm_w):
        def judged(norm):
            def again(u):
                return let(squared_norm(u), lambda n: distance(u, w, n * norm_w))

            return (
                F.when(norm.between(*ORDINARY), distance(v, w, norm * norm_w))
                .when(directed(v), let(scaled(v), again))
                .otherwise(nan)
            )

        return let(squared_norm(v), judged)

    if squared_norm_b is not None:
        return F.when(squared_norm_b > 0, between(a, b, squared_norm_b)).otherwise(nan)

    def other(norm):
        def again(u):
            return between(a, u, squared_norm(u))

        return (
            F.when(norm.between(*ORDINARY), between(a, b, norm))
            .when(directed(b), let(scaled(b), again))
            .otherwise(nan)
        )

    return let(squared_norm(b), other)


def similarity(distance: Column) -> Column:
    """Cosine distance as a score between 0 and 1."""
    return 1.0 - distance / 2.0


def resized(vector: Column, size: int) -> Column:
    """Pad with zeros or cut to ``size`` values."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(size - F.size(vector), F.lit(0)))
    return F.when(
        vector.isNotNull(), F.slice(F.concat(vector, padding), 1, size)
    )


def from_named_values(vector_map: Column, size: int) -> Column:
    """A vector delivered as a map: its values in stored order, resized."""
    return resized(F.map_values(vector_map).cast("array<float>"), size)
