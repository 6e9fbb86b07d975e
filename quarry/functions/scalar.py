"""Column functions used by the mining operators.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers and offsets (a, b) of the hash family ((a x + b) mod p) mod m; fixed, so that runs and SQL agree.
PRIME = 1_000_000_007
FAMILY = [((7_919 * (i + 1) * (i + 3) + 101) % PRIME, (104_729 * (i + 1) + 13 * i * i) % PRIME) for i in range(64)]


def universal_hash(x: Column, i: int, m: int, p: int = PRIME) -> Column:
    """Member i of the family, on values 0 <= x < 2**32."""
    a, b = FAMILY[i]
    return F.pmod(F.pmod(F.lit(a).cast("bigint") * F.pmod(x.cast("bigint"), F.lit(p)) + F.lit(b), F.lit(p)), F.lit(m))


def universal_hash_sql(x: str, i: int, m: int, p: int = PRIME) -> str:
    a, b = FAMILY[i]
    return f"((({a}::BIGINT * (({x}) % {p}) + {b}) % {p}) % {m})"


def text_key(c: Column) -> Column:
    """A stable 32-bit number for a string; also expressible in SQL."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def text_key_sql(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"


def pair_bucket(a: Column, b: Column, buckets: int) -> Column:
    """Bucket of an unordered pair of non-negative numbers."""
    return F.pmod(a.bitwiseXOR(b), F.lit(buckets))


def trailing_zeros(x: Column) -> Column:
    """Zero bits at the low end; 1 for the value 0."""
    return F.when(x == 0, 1).otherwise(F.bit_count(x.bitwiseAND(-x) - F.lit(1)))


def list_size(c: Column, sep: str = ",") -> Column:
    """Entries of a separated list; 0 for null, empty and the literal 'None'."""
    return F.when(c.isNull() | (c == "") | (c == "None"), 0).otherwise(F.size(F.split(c, sep)))


def map_size(c: Column) -> Column:
    """Entries of a map, 0 for null."""
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def years_between(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day) / F.lit(365.25)


def mean_of(*columns: Column) -> Column:
    """Row-wise mean; null if any is null."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))


def short_date(c: Column) -> Column:
    """M/D/YYYY as M/D/YY, leading zeros kept as written."""
    p = F.split(c, "/")
    return F.concat_ws("/", p[0], p[1], F.substring(p[2], 3, 2))


def strip_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def plain_integer(c: Column) -> Column:
    """An integer string without leading zeros; null if it isn't one."""
    return c.try_cast("bigint").cast("string")


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def amplify(r: Column, power: float = 2.5) -> Column:
    """Signed case amplification of a similarity."""
    return F.signum(r) * F.pow(F.abs(r), F.lit(power))


def jaccard(inter: Column, na: Column, nb: Column) -> Column:
    """0 where the union is empty."""
    return F.coalesce(F.try_divide(inter.cast("double"), (na + nb - inter).cast("double")), F.lit(0.0))


def mahalanobis(x: Column, centre: Column, std: Column) -> Column:
    """Distance under a diagonal covariance.

    A dimension without spread adds nothing where it agrees, and makes the
    distance infinite where it doesn't.
    """
    part = F.zip_with(
        F.zip_with(x, centre, lambda a, b: a - b),
        std,
        lambda d, s: F.when(s > 0, F.pow(d / s, F.lit(2.0))).when(F.abs(d) < 1e-12, F.lit(0.0)).otherwise(F.lit(float("inf"))),
    )
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v))
