"""Array arithmetic as JVM-side column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(value: Column, n: Column | int) -> Column:
    return F.array_repeat(value, n if isinstance(n, Column) else F.lit(n))


def ramp(n: int, scale: Column, modulo: int | None = None) -> Column:
    """[0*scale, 1*scale, ...]; with modulo, (i % modulo) * scale."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(i, lambda x: (x % modulo if modulo else x) * scale)


def sgd_step(weights: Column, gradient: Column, rate: float) -> Column:
    return F.zip_with(weights, gradient, lambda w, g: w - F.lit(rate) * g)


def sgd_steps(weights: Column, gradients: Column, rate: float) -> Column:
    """Tensors by position, with their gradients; a tensor whose gradient is null stays as it is."""
    return F.zip_with(weights, gradients, lambda w, g: F.when(g.isNull(), w).otherwise(sgd_step(w, g, rate)))


def uniform(key: Column, n: int, seed: int = 0) -> Column:
    """n numbers in [0, 1) that depend on the key and the seed only, whatever the partitioning."""
    bits = lambda i: F.shiftrightunsigned(F.xxhash64(key, i, F.lit(seed)), 11)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: bits(i) / F.lit(float(1 << 53)))


def max_pool(v: Column, width: int) -> Column:
    """The largest of each width consecutive elements; a shorter tail is left out."""
    last = F.floor(F.size(v) / width).cast("int")
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_max(F.slice(v, (i - 1) * width + 1, width)))).otherwise(F.slice(v, 1, 0))


def matmul(rows: Column, v: Column) -> Column:
    """The product of a matrix, as an array of rows, and a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def argmax(v: Column) -> Column:
    """Position of the largest element; the first wins ties; null for null or empty."""
    return F.nullif(F.array_position(v, F.array_max(v)), F.lit(0)) - 1


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(v, lambda x: x - top - F.log(total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def byte_size(v: Column, width: int = 4) -> Column:
    return F.size(v).cast("long") * width
