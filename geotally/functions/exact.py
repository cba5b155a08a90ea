"""Exact shares beyond the places that Spark's decimals keep, as whole numbers of small units.

A share is a whole number of 10^-24.  Quotients are worked out in halves of twelve digits, so that
every step fits decimal(38,0); products, of which a walk has very many, in limbs of eight digits,
so that every step fits a long.  No rounding but the one asked for, half to even.

What very many rows need is made step by step (``with_times`` and the like), of longs where they suffice: quotients and
remainders of large decimals are hundreds of times slower, and as one expression the steps become a method
that the JVM doesn't compile.  Each step's column is used twice, so Spark keeps the steps apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ten to the twelfth, and a whole share in units.
_HALF = "1000000000000"
ONE = "1000000000000000000000000"


def whole(x: Column | int | str) -> Column:
    """A whole number of up to 38 digits."""
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")


def _half(x: Column | int | str) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(13,0)")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, for quotients that fit a long; null where b is zero."""
    return F.call_function("div", whole(a), F.when(b != 0, whole(b)))


def upper(x: Column) -> Column:
    """What is above the last twelve digits, a long (of numbers from 0 to 10^25)."""
    return (x.cast("decimal(25,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("long")


def lower(x: Column) -> Column:
    """The last twelve digits, a long (of numbers from 0 to 10^25)."""
    return (x.cast("decimal(25,0)") - upper(x).cast("decimal(13,0)") * _half(_HALF)).cast("long")


def _digits(rest: Column, b: Column) -> tuple[Column, Column]:
    """The next twelve digits of a quotient by ``b`` (under 10^24), and what is left."""
    scaled = whole(rest.cast("decimal(25,0)") * _half(_HALF))
    found = _div(scaled, b).cast("decimal(19,0)")
    return found, whole(scaled - found * b.cast("decimal(24,0)"))


def rounded(quotient: Column, rest: Column, by: Column) -> Column:
    """The quotient, one more if the rest is over half of ``by``, or half of it and the quotient odd."""
    twice = whole(rest * 2)
    up = (twice > by) | ((twice == by) & (quotient % 2 == 1))
    return whole(quotient + F.when(up, 1).otherwise(0))


def share(a: Column, b: Column) -> Column:
    """a / b in units of 10^-24, half to even; null where b is zero (0 <= a <= b < 10^24)."""
    first, rest = _digits(a, b)
    second, rest = _digits(rest, b)
    return rounded(whole(first * _half(_HALF) + second), rest, b)


def times(bucket: Column, a: Column, b: Column) -> Column:
    """bucket * a / b in units of 10^-36, half to even (bucket and a in units of 10^-12, a <= b < 10^24)."""
    product = whole(_half(bucket) * _half(a))
    first = _div(product, b).cast("decimal(13,0)")
    second, rest = _digits(product - first * b.cast("decimal(24,0)"), b)
    third, rest = _digits(rest, b)
    low = second * _half(_HALF) + third
    return rounded(whole(first.cast("decimal(13,0)") * F.lit(ONE).cast("decimal(25,0)") + low), rest, b)


#: Divisors under this many leave remainders of which the thousandfold fits a long.
_SHORT = 9 * 10**15
_TWELVE = 10**12


def quick_units(x: Column, places: int) -> Column:
    """A double as a whole number of 10^-places, a long, where that is what its cast to a decimal gives: its shortest text has at most
    so many places and the number at most fifteen digits.  Null elsewhere.

    Two numbers of up to fifteen digits are never one double, so one that reads as the double again is its text.
    """
    by = float(10**places)
    found = F.rint(x * by)
    return F.when((F.abs(found) < 1e15) & (found / by == x), found.cast("long"))


def with_short_times(df: DataFrame, names: list[str], bucket: Column, a: Column, b: Column) -> DataFrame:
    """``with_times`` for divisors under 9 * 10^15, counts for example: long division by three digits at a time."""
    c = F.col
    by = lambda x: c(x) % c("__b")
    steps = df.withColumns({"__b": b.cast("decimal(16,0)").cast("long"), "__k": bucket.cast("long"), "__a": a.cast("long")})
    low = c("__k") % 1_000_000
    steps = steps.withColumn("__t0", _long_div(c("__k"), 1_000_000) * c("__a"))
    steps = steps.withColumn("__t1", by("__t0") * 1000 + _long_div(low, 1000) * c("__a"))
    steps = steps.withColumn("__t2", by("__t1") * 1000 + low % 1000 * c("__a"))
    for i in range(3, 11):
        steps = steps.withColumn(f"__t{i}", by(f"__t{i - 1}") * 1000)
    digit = lambda i: F.call_function("div", c(f"__t{i}"), c("__b"))

    def digits(first: int, last: int) -> Column:
        found = digit(first)
        for i in range(first + 1, last + 1):
            found = found * 1000 + digit(i)
        return found

    steps = steps.withColumns({"__h": digits(0, 2), "__m": digits(3, 6), "__l": digits(7, 10), "__twice": by("__t10") * 2})
    up = (c("__twice") > c("__b")) | ((c("__twice") == c("__b")) & (c("__l") % 2 == 1))
    return steps.select(*df.columns, c("__h").alias(names[0]), c("__m").alias(names[1]), (c("__l") + F.when(up, 1).otherwise(0)).alias(names[2]))


def with_times(df: DataFrame, names: list[str], bucket: Column, a: Column, b: Column) -> DataFrame:
    """All columns and ``times`` as the three ``names``: longs of twelve digits, the highest first (the lowest may be
    10^12), so that they can be summed one by one (see ``with_units``).

    Rows whose divisor is too large for ``with_short_times`` take the way of decimals, as a branch of
    their own: in one method with the others it would keep them from being compiled.
    """
    c = F.col
    near = with_short_times(df.where(b < F.lit(_SHORT)), names, bucket, a, b)
    far = df.where(b >= F.lit(_SHORT)).withColumn("__u", times(bucket, a, b))
    far = far.withColumn("__h", _div(c("__u"), F.lit(ONE).cast("decimal(25,0)"))).withColumn("__rest", c("__u") - c("__h").cast("decimal(13,0)") * F.lit(ONE).cast("decimal(25,0)"))
    return near.unionByName(far.select(*df.columns, c("__h").alias(names[0]), upper(c("__rest")).alias(names[1]), lower(c("__rest")).alias(names[2])))


def with_units(df: DataFrame, name: str, parts: list[Column]) -> DataFrame:
    """All columns and ``name``: sums of the longs of ``with_times`` as units of 10^-24, half to even."""
    high, middle, low = parts
    steps = df.withColumn("__m", middle + _long_div(low, _TWELVE)).withColumn("__l", low % _TWELVE)
    up = (F.col("__l") > _TWELVE // 2) | ((F.col("__l") == _TWELVE // 2) & (F.col("__m") % 2 == 1))
    return steps.select(*df.columns, whole(high.cast("decimal(13,0)") * _half(_HALF) + (F.col("__m") + F.when(up, 1).otherwise(0)).cast("decimal(19,0)")).alias(name))


def with_unit_limbs(df: DataFrame, names: list[str], parts: list[Column]) -> DataFrame:
    """All columns and ``with_units`` as the ``limbs`` of the three ``names``, in longs throughout."""
    high, middle, low = parts
    steps = df.withColumn("__m", middle + _long_div(low, _TWELVE)).withColumn("__l", low % _TWELVE)
    up = (F.col("__l") > _TWELVE // 2) | ((F.col("__l") == _TWELVE // 2) & (F.col("__m") % 2 == 1))
    steps = steps.withColumn("__n", F.col("__m") + F.when(up, 1).otherwise(0))
    steps = steps.withColumns({"__h": high + _long_div(F.col("__n"), _TWELVE), "__r": F.col("__n") % _TWELVE})
    found = [F.col("__r") % _LIMB, _long_div(F.col("__r"), _LIMB) + F.col("__h") % 10_000 * 10_000, _long_div(F.col("__h"), 10_000)]
    return steps.select(*df.columns, *[x.alias(n) for x, n in zip(found, names, strict=True)])


#: The base of limbs.
_LIMB = 100_000_000


def limbs(units: Column) -> list[Column]:
    """A share as three longs of eight digits, the lowest first (the last may be 10^8, a whole share)."""
    high, low = upper(units), lower(units)
    return [low % _LIMB, _long_div(low, _LIMB) + high % 10_000 * 10_000, _long_div(high, 10_000)]


def _long_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def three_quarters(a: list[Column], b: list[Column]) -> list[Column]:
    """0.75 * a * b of two shares given as limbs, in units of 10^-30, half to even, as four limbs (the
    lowest may be 10^8; limbs of many products can be summed one by one).

    The product P has units of 10^-48, so the result is 3 P / (4 * 10^18): the lowest two limbs of
    3 P fall away as a rest, and what is above them is divided by 400.
    """
    columns = [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[0] * b[2] + a[1] * b[1] + a[2] * b[0], a[1] * b[2] + a[2] * b[1], a[2] * b[2]]
    digits, carry = [], F.lit(0).cast("long")
    for c in columns:
        now = c * 3 + carry
        digits.append(now % _LIMB)
        carry = _long_div(now, _LIMB)
    digits.append(carry)
    found, rest = [], F.lit(0).cast("long")
    for d in reversed(digits[2:]):
        now = rest * _LIMB + d
        found.append(_long_div(now, 400))
        rest = now % 400
    high, *middle, low = found
    more = (digits[0] > 0) | (digits[1] > 0)
    up = (rest > 200) | ((rest == 200) & (more | (low % 2 == 1)))
    return [low + F.when(up, 1).otherwise(0), *reversed(middle), high]


def with_three_quarters(df: DataFrame, names: list[str], a: list[Column], b: list[Column]) -> DataFrame:
    """All columns and ``three_quarters`` of two shares as the four ``names``, step by step."""
    columns = [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[0] * b[2] + a[1] * b[1] + a[2] * b[0], a[1] * b[2] + a[2] * b[1], a[2] * b[2]]
    steps, carry = df, F.lit(0).cast("long")
    for i, c in enumerate(columns):
        steps = steps.withColumn(f"__n{i}", c * 3 + carry)
        carry = _long_div(F.col(f"__n{i}"), _LIMB)
    digits = [*[F.col(f"__n{i}") % _LIMB for i in range(5)], carry]
    rest = F.lit(0).cast("long")
    for i in (5, 4, 3, 2):
        steps = steps.withColumn(f"__d{i}", rest * _LIMB + digits[i])
        rest = F.col(f"__d{i}") % 400
    low, *above = [_long_div(F.col(f"__d{i}"), 400) for i in (2, 3, 4, 5)]
    steps = steps.withColumns({"__low": low, "__left": rest})
    more = (digits[0] > 0) | (digits[1] > 0)
    up = (F.col("__left") > 200) | ((F.col("__left") == 200) & (more | (F.col("__low") % 2 == 1)))
    return steps.select(*df.columns, *[x.alias(n) for x, n in zip([F.col("__low") + F.when(up, 1).otherwise(0), *above], names, strict=True)])


def from_limbs(parts: list[Column]) -> Column:
    """The whole number that limbs (or sums of limbs) stand for."""
    total = whole(parts[-1])
    for p in reversed(parts[:-1]):
        total = whole(whole(total * F.lit(_LIMB).cast("decimal(9,0)")) + p)
    return total


def drop_digits(x: Column, digits: int) -> Column:
    """A whole number without its last ``digits`` digits, half to even (of results under 10^25)."""
    by = F.lit("1" + "0" * digits).cast(f"decimal({digits + 1},0)")
    rest = whole(x) % by
    quotient = ((whole(x) - rest) * F.lit("0." + "0" * (digits - 1) + "1").cast(f"decimal({digits},{digits})")).cast("decimal(26,0)")
    return rounded(quotient, rest, by)


def as_decimal(units: Column) -> Column:
    """Units of 10^-24 as a decimal with 24 places (of numbers under 10)."""
    high = (upper(units).cast("decimal(13,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(26,24)")
    low = (lower(units).cast("decimal(12,0)") * F.lit("0.000000000000000000000001").cast("decimal(24,24)")).cast("decimal(25,24)")
    return (high + low).cast("decimal(38,24)")


def as_units(x: Column, places: int = 12) -> Column:
    """A decimal with up to twelve places as a whole number of 10^-12."""
    return (x.cast("decimal(24,12)") * _half(_HALF)).cast("decimal(24,0)")
