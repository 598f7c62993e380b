"""Numeric and bit functions with the dialect's semantics, as Column expressions; UDFs only where the JVM has nothing."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def even(x: Column) -> Column:
    """Away from zero to the next even number."""
    return (F.signum(x) * F.ceil(F.abs(x) / 2) * 2).cast("double")


def log10(x: Column) -> Column:
    return F.log10(x)


def log(*args: Column) -> Column:
    """log(x) to base 10, or log(base, x)."""
    return F.log10(args[0]) if len(args) == 1 else F.ln(args[1]) / F.ln(args[0])


def ln(x: Column) -> Column:
    """-inf at zero."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def divide(a: Column, b: Column) -> Column:
    """True division; by zero an infinity of a's sign, or NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNotNull() & (a > 0), F.lit(float("inf"))).when(b.isNotNull() & (a < 0), F.lit(float("-inf"))).when(b.isNotNull() & a.isNotNull(), F.lit(float("nan")))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, unrolled as far as 64-bit numbers can need."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """In whole numbers, which are exact beyond 2**53 too."""
    g = gcd(a, b)
    part = F.call_function("div", a.cast("long"), F.when(g != 0, g).otherwise(1))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(part * b.cast("long")))


def _gamma(v: float) -> float:
    if v == 0 or v == math.inf:
        return math.copysign(math.inf, v)
    if v < 0 and v == math.floor(v):
        return math.nan
    try:
        return math.gamma(v)
    except OverflowError:
        return math.inf


def _lgamma(v: float) -> float:
    return math.inf if v <= 0 and v == math.floor(v) else math.lgamma(v)


@F.arrow_udf(T.DoubleType())
def gamma(x: pa.Array) -> pa.Array:
    """Infinity at zero and beyond 171.6, NaN at negative whole numbers."""
    return pa.array([None if v is None else _gamma(v) for v in x.to_pylist()], pa.float64())


@F.arrow_udf(T.DoubleType())
def lgamma(x: pa.Array) -> pa.Array:
    """Infinity at zero and negative whole numbers."""
    return pa.array([None if v is None else _lgamma(v) for v in x.to_pylist()], pa.float64())


def beta(a: Column, b: Column) -> Column:
    return F.exp(lgamma(a) + lgamma(b) - lgamma(a + b))


def isinf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def isfinite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def signbit(x: Column) -> Column:
    """True for negative numbers and negative zero."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def get_bit(bits: Column, place: Column | int) -> Column:
    """Of a string of 0 and 1, from the left and 0."""
    return F.substr(bits, F.lit(place) + 1, F.lit(1)).cast("int")


def set_bit(bits: Column, place: int, value: int) -> Column:
    return F.overlay(bits, F.lit(str(value)), F.lit(place + 1), F.lit(1))


def bit_length(s: Column) -> Column:
    return F.octet_length(s) * 8


#: The seed that setseed() left for random().
_seed: list[int | None] = [None]


def setseed(x: float) -> Column:
    """From now on random() draws the same numbers for the same plan; null, as the dialect has it."""
    _seed[0] = int(x * 2**31)
    return F.lit(None)


def random() -> Column:
    return F.rand(_seed[0])


def hash(*values: Column) -> Column:  # noqa: A001  the dialect's name
    """FNV-1a over the UTF-8 of the values' text, as a 64-bit number in two's complement."""
    # FNV-1a's offset basis and prime, 2**40 + 435. Products go by halves of 32 bits, as long ones overflow.
    mask = F.lit(0xFFFFFFFF)
    text = F.concat_ws("\x1f", *(v.cast("string") for v in values))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda k: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), k, F.lit(1))), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        low = h["low"].bitwiseXOR(byte)
        product = low * 435
        high = (h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8).bitwiseAND(mask)).bitwiseAND(mask)
        return F.struct(high.alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    folded = F.aggregate(F.when(text == "", F.array().cast("array<bigint>")).otherwise(codes), start, step)
    return F.transform(F.array(folded), lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"]))[0]
