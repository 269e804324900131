"""Unsigned 64-bit arithmetic on Spark's signed longs and decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = Decimal(1 << 64)
I64_MAX = (1 << 63) - 1
#: A sum is added up in limbs of so many bits, so that longs don't overflow below 2**45 rows.
LIMB_BITS = 18
LIMBS = 4


def literal(value: int) -> Column:
    """A constant of 0 .. 2**64 - 1; beyond a long as decimal."""
    return F.lit(value) if value <= I64_MAX else F.lit(Decimal(value)).cast("decimal(20,0)")


def limbs(column: Column, kind: T.DataType, high: int | None = None) -> list[Column]:
    """Columns whose sums make that of an unsigned column; high: its known maximum.

    A long column needs shifts and long additions only, within whole-stage codegen; decimals are added as they are."""
    if isinstance(kind, T.DecimalType):
        return [column.cast("decimal(20,0)")]
    n = LIMBS if high is None else max(1, min(LIMBS, -(-high.bit_length() // LIMB_BITS)))
    if n == 1:
        return [column.cast("long")]
    mask = F.lit((1 << LIMB_BITS) - 1)
    parts = [F.shiftrightunsigned(column.cast("long"), LIMB_BITS * k) for k in range(n)]
    return [p.bitwiseAND(mask) for p in parts[:-1]] + [parts[-1]]


def from_limbs(sums: list[Column], zero_is_null: bool, signed: bool = False) -> Column:
    """The sum modulo 2**64, as decimal(20,0), or long if signed (two's complement above 2**63 - 1)."""
    wide = [s.cast("decimal(38,0)") for s in sums]
    total = F.pmod(sum((s * F.lit(Decimal(1 << (LIMB_BITS * k))).cast("decimal(18,0)") for k, s in enumerate(wide[1:], 1)), wide[0]).cast("decimal(38,0)"), F.lit(U64).cast("decimal(20,0)"))
    if zero_is_null:
        total = F.nullif(total, F.lit(Decimal(0)))
    if signed:
        return F.when(total > I64_MAX, total - F.lit(U64)).otherwise(total).cast("long")
    return total.cast("decimal(20,0)")
