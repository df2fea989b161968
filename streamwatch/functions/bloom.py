"""Bloom-filter counting: integer hashes, bit positions, and the number of members from the share of bits set.

Every member sets ``hashes`` of ``bits`` bits. Of X bits set the number of
distinct members is estimated as ``-(bits / hashes) * ln(1 - X / bits)``. With
n members and t = hashes * n / bits its standard error is about
``sqrt(bits * (exp(t) - t - 1)) / hashes``: 0.13 % of a million members with the
defaults (128 KB), and less than one for a thousand. The estimate depends on
the set of members alone, not on order or partitioning, so batch and stream agree.

Hashes are rounds of integer arithmetic that any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 1 << 20
HASHES = 3
#: Bits of one bitmap of ``bitmap_construct_agg``.
SLICE = 32_768
# A Mersenne prime, and the multipliers of the rounds of both hashes.
PRIME = 2_147_483_647
ROUNDS = ((1_103_515_245, 1_597_334_677, 812_115_677), (747_796_405, 1_181_783_497, 668_265_263))


def mix(low: Column, high: Column, multipliers: tuple[int, ...]) -> Column:
    """A number below ``PRIME`` from both parts of a long; products stay below 2^62."""
    prime, y = F.lit(PRIME).cast("long"), low
    for i, m in enumerate(multipliers):
        y = F.pmod((y.bitwiseXOR(F.shiftright(y, 15)) + 1) * F.lit(m).cast("long"), prime)
        if not i:
            y = F.pmod(y + F.pmod(high, prime) * F.lit(multipliers[-1]).cast("long"), prime)
    return y


def whole_number(member: Column, kind: str) -> Column:
    """A long for each value: itself if it is a whole number, else its 64-bit hash."""
    return member.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(member)


def bitmap_positions(member: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits that a member (a long) sets, from 1 to ``bits``; null for a null member, which sets none.

    The low 31 bits and the rest enter apart, so every bit counts.
    """
    if bits % SLICE:
        raise ValueError(f"bits must be a multiple of {SLICE}")
    low, high = member.bitwiseAND(F.lit(PRIME).cast("long")), F.shiftright(member, 31)
    one, two = mix(low, high, ROUNDS[0]), mix(low, high, ROUNDS[1])
    places = F.array(*[F.pmod(one + i * two, F.lit(bits).cast("long")) + 1 for i in range(hashes)])
    return F.when(member.isNotNull(), places).otherwise(F.array(F.lit(None).cast("long")))


def bloom_estimate(n_set: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """Distinct members of a filter with ``n_set`` bits set; a full filter gives the most that can be told."""
    share = F.least(n_set, F.lit(bits - 1)) / F.lit(float(bits))
    return F.round(-F.lit(bits / hashes) * F.log(1 - share)).cast("long")
