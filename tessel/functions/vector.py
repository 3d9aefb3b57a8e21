"""Vector arithmetic on array columns, folded from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: list[float]) -> Column:
    """A query vector as a literal."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; 0 where the lengths differ or a vector is empty or null."""
    a, b = _c(a), _c(b)
    product = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(F.lit(0.0))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column | str) -> Column:
    """The unit vector; null for a zero vector."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n)))[0]


def truncated(v: Column | str, dims: int) -> Column:
    """The first dims components, normalised anew."""
    return l2_normalize(F.slice(_c(v), 1, dims))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sign_words(v: Column | str, width: int = 32) -> Column:
    """Sign bits, `width` to a word; a component of 0 or more sets its bit."""
    v = _c(v)
    starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))
    bits = lambda s: F.transform(F.slice(v, s * width + 1, width), lambda x, i: F.when(x >= 0, F.expr("1L").bitwiseAND(F.lit(1))).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2.0), i).cast("long"))
    return F.transform(starts, lambda s: F.aggregate(bits(s), F.lit(0).cast("long"), lambda a, x: a + x))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def to_csv(v: Column | str, decimals: int = 6) -> Column:
    """Comma-joined components, rounded half away from zero."""
    return F.array_join(F.transform(_c(v), lambda x: F.round(x.cast("double"), decimals).cast("string")), ",")


def from_csv(s: Column | str) -> Column:
    """Components of a comma-joined vector; null where any is empty or no number."""
    parts = F.transform(F.split(_c(s), ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)
