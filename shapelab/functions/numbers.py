"""Rounding and wrapping 64-bit arithmetic that holds under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF


def round6(x: Column) -> Column:
    """x to the nearest millionth, halves away from zero."""
    return F.round(x * F.lit(1e6)) / F.lit(1e6)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def high32(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 on signed longs, without overflow errors."""
    low = low32(a) + low32(b)
    high = high32(a) + high32(b)
    return bound(low, lambda s: F.shiftleft(low32(high + F.shiftrightunsigned(s, 32)), 32).bitwiseOR(low32(s)))


def mul64(a: Column, constant: int) -> Column:
    """a * constant modulo 2**64; the constant is cut into 16-bit limbs, so that no
    partial product reaches 2**52."""
    c = [(constant >> s) & 0xFFFF for s in (0, 16, 32, 48)]

    def with_halves(x: Column) -> Column:
        lo, hi = low32(x), high32(x)
        mid = bound(lo * F.lit(c[1]), lambda m: F.struct((F.lit(0) + lo * F.lit(c[0]) + F.shiftleft(m.bitwiseAND(F.lit(0xFFFF)), 16)).alias("low"), F.shiftrightunsigned(m, 16).alias("carry")))
        return bound(
            mid,
            lambda m: F.shiftleft(
                low32(
                    F.shiftrightunsigned(m["low"], 32) + m["carry"] + lo * F.lit(c[2]) + F.shiftleft((lo * F.lit(c[3])).bitwiseAND(F.lit(0xFFFF)), 16)
                    + hi * F.lit(c[0]) + F.shiftleft((hi * F.lit(c[1])).bitwiseAND(F.lit(0xFFFF)), 16)
                ),
                32,
            ).bitwiseOR(low32(m["low"])),
        )

    return bound(a, with_halves)


def xor_shift(x: Column, bits: int) -> Column:
    return bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


# Fixed values of the generator: its increment and its two multipliers.
GAMMA = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def finalize(z: Column) -> Column:
    """The output mix of splitmix64."""
    return xor_shift(mul64(xor_shift(mul64(xor_shift(z, 30), MIX[0]), 27), MIX[1]), 31)


def draw(state: Column, step: int = 1) -> Column:
    """The step-th output of a splitmix64 stream with that state."""
    return finalize(add64(state, F.lit(signed(GAMMA * step % 2**64))))


def uniform(bits: Column) -> Column:
    """[0, 1) from the top 53 bits."""
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(2**53))


def modulo(bits: Column, n: int) -> Column:
    """bits read as unsigned, modulo n; 0 for n <= 0."""
    if n <= 0:
        return F.lit(0).cast("long")
    if n < 2**31:
        return bound(bits, lambda x: ((high32(x) % F.lit(n)) * F.lit(2**32 % n) + low32(x) % F.lit(n)) % F.lit(n))
    wide = F.when(bits < 0, bits.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits.cast("decimal(20,0)"))
    return (wide % F.lit(n).cast("decimal(20,0)")).cast("long")


def cell_state(seed: int, table: str, column: str, ordinal: Column) -> Column:
    """The stream of one cell: the first 8 bytes of SHA-256 over the framed coordinates.
    All but the ordinal is one literal."""
    frame = lambda s: len(s.encode()).to_bytes(8, "big") + s.encode()
    prefix = (seed % 2**64).to_bytes(8, "big") + frame(table) + frame(column)
    data = F.concat(F.unhex(F.lit(prefix.hex())), F.unhex(F.lpad(F.hex(ordinal), 16, "0")))
    head = F.substring(F.sha2(data, 256), 1, 16)
    return bound(head, lambda h: F.shiftleft(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(h, 9, 8), 16, 10).cast("long")))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def saturating_long(x: Column) -> Column:
    """A double truncated to long; NaN is 0 and values out of range stop at the ends."""
    return F.when(F.isnan(x), F.lit(0)).when(x >= F.lit(9.223372036854775807e18), F.lit(2**63 - 1)).when(x <= F.lit(-9.223372036854775808e18), F.lit(-(2**63))).otherwise(x.cast("long"))
