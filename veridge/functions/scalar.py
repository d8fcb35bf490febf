"""Scalar expressions: masks, bits, smallest absent values, reduced precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iif(cond: Column, when_false: Column, when_true: Column) -> Column:
    """The third operand where ``cond`` holds, else the second (the reference order of operands)."""
    return F.when(cond, when_true).otherwise(when_false)


def masked(mask: Column, x: Column) -> Column:
    """``x`` where the mask holds, else null, which aggregates skip."""
    return F.when(mask, x)


def iforz(mask: Column, x: Column) -> Column:
    return F.when(mask, x).otherwise(F.lit(0))


def lzcnt(x: Column, bits: int = 64) -> Column:
    """Leading zeros of a non-negative or negative integer in ``bits`` bits."""
    x = x.cast("long")
    return F.when(x == 0, bits).when(x < 0, 0).otherwise(bits - F.length(F.bin(x)))


def tzcnt(x: Column, bits: int = 64) -> Column:
    x = x.cast("long")
    return F.when(x == 0, bits).otherwise(F.bit_count((x.bitwiseAND(F.bitwise_not(x) + 1)) - 1) if bits < 64 else F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1)))


def mulhi(a: Column, b: Column, bits: int = 32) -> Column:
    """The upper half of a product of unsigned ``bits``-bit integers, at most 32."""
    return F.shiftrightunsigned(a.cast("long") * b.cast("long"), bits)


def adds(a: Column, b: Column, limit: int) -> Column:
    """A sum that stays at ``limit``."""
    return F.least(a + b, F.lit(limit))


def mex(used: Column) -> Column:
    """The smallest non-negative integer that isn't in an array."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), F.transform(used, lambda x: x.cast("int"))))


def unique_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def intersect_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def truncated(x: Column, exponent: int, mantissa: int) -> Column:
    """A float cut to ``mantissa`` bits without rounding; what is under the least exponent becomes zero, what is over the largest stays there."""
    x = x.cast("double")
    e = F.floor(F.log2(F.abs(x)))
    step = F.pow(F.lit(2.0), e - mantissa)
    bias = (1 << exponent - 1) - 1
    cut = F.signum(x) * F.floor(F.abs(x) / step) * step
    top = (2 - 2.0**-mantissa) * 2.0**bias if bias < 1000 else float("inf")
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).when(e < -bias, F.lit(0.0)).when(F.abs(x) > top, F.signum(x) * top).otherwise(cut)


def and_not(a: Column, b: Column) -> Column:
    """The bits of ``b`` that ``a`` hasn't."""
    return F.bitwise_not(a).bitwiseAND(b)


def and_zero(a: Column, b: Column) -> Column:
    """Whether two masks share no bit."""
    return a.bitwiseAND(b) == 0


def sign_set(x: Column) -> Column:
    """Whether the highest bit is set."""
    return x < 0


def all_ones(x: Column) -> Column:
    return x == -1


def negated(mask: Column) -> Column:
    """What a comparison leaves out, as nulls of either operand leave it out too."""
    return ~mask


def shift_right_signed(x: Column, n: int) -> Column:
    """Arithmetic shift: the sign comes in."""
    return F.shiftright(x, n)


def wrapped(x: Column, bits: int, signed: bool = True) -> Column:
    """The low ``bits`` bits of an integer, under 64, as a signed or unsigned number."""
    low = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low) if signed else low


def try_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def smallest_false(flags: Column) -> Column:
    """The first place of an array of booleans that isn't true; its size if all are."""
    at = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(flags)).cast("int")


def find_first(values: Column, pred) -> Column:
    """The first place of an array whose value meets ``pred``; -1 if none does."""
    return (F.array_position(F.transform(values, lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(True)) - 1).cast("int")


def loop(first: Column, times: Column, step) -> Column:
    """``step(value, i)`` for i from 0 up to ``times``, each on what the one before made; a value that is carried keeps the type of ``first``."""
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(times.cast("int") - 1, F.lit(0))), first, step)).otherwise(first)


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles with the rounding error of each step carried along."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, zero, step, lambda a: a["s"] + a["c"])
