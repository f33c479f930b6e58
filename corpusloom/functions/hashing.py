"""Digests and counter-based random draws, as Column expressions.

64-bit values are kept as two 32-bit halves, since a wrapping multiplication overflows under ANSI
rules, and come out as 16 lower-case hexadecimal digits, whose text order is the unsigned order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

# The 64-bit FNV-1a offset basis and the low part of its prime (2^40 + 0x1b3), the SplitMix64 constants.
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LOW = 0xFFFFFFFF
UNIT = "\x1f"


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def fnv1a64(c: Column | str, seed: int = 0) -> Column:
    """FNV-1a over the UTF-8 bytes; the seed is mixed into the offset basis. Null stays null."""
    # One character per byte, so that its code is the byte.
    as_bytes = F.filter(F.split(F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1"), ""), lambda b: b != "")

    def step(acc: Column, byte: Column) -> Column:
        x = acc["lo"].bitwiseXOR(F.ascii(byte).cast("bigint"))
        wide = x * _long(FNV_PRIME_LOW)
        lo = wide.bitwiseAND(_long(LOW))
        hi = (acc["hi"] * _long(FNV_PRIME_LOW) + F.shiftright(wide, 32) + F.shiftleft(x, 8)).bitwiseAND(_long(LOW))
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    start = F.struct(_long(FNV_HIGH ^ (seed >> 32)).alias("hi"), _long(FNV_LOW ^ (seed & LOW)).alias("lo"))
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(as_bytes, start, step, lambda acc: F.concat(half(acc["hi"]), half(acc["lo"])))


def split_hash(id_: Column, label: Column, normal: Column, seed: int) -> Column:
    return fnv1a64(F.concat(id_, F.lit(UNIT), label, F.lit(UNIT), normal), seed)


def group_split_hash(label: Column, group: Column, seed: int) -> Column:
    return fnv1a64(F.concat(label, F.lit(UNIT), group), seed)


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def _halves(hi: Column, lo: Column) -> Column:
    return F.struct(hi.bitwiseAND(_long(LOW)).alias("hi"), lo.bitwiseAND(_long(LOW)).alias("lo"))


def _add(a: Column, b: int) -> Column:
    lo = a["lo"] + _long(b & LOW)
    return _halves(a["hi"] + _long(b >> 32) + F.shiftright(lo, 32), lo)


def _mul(a: Column, b: int) -> Column:
    """Low 64 bits of a product, by 16-bit parts so that nothing overflows."""
    part = [a["lo"].bitwiseAND(_long(0xFFFF)), F.shiftright(a["lo"], 16), a["hi"].bitwiseAND(_long(0xFFFF)), F.shiftright(a["hi"], 16)]
    by = [b >> 16 * i & 0xFFFF for i in range(4)]
    out, carry = [], _long(0)
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + part[i] * _long(by[k - i])
        out.append(total.bitwiseAND(_long(0xFFFF)))
        carry = F.shiftright(total, 16)
    return _halves(out[2] + F.shiftleft(out[3], 16), out[0] + F.shiftleft(out[1], 16))


def _xor_shift(a: Column, by: int) -> Column:
    """x ^ (x >>> by) for a shift below 32."""
    lo = F.shiftright(a["lo"], by).bitwiseOR(F.shiftleft(a["hi"], 32 - by).bitwiseAND(_long(LOW)))
    return _halves(a["hi"].bitwiseXOR(F.shiftright(a["hi"], by)), a["lo"].bitwiseXOR(lo))


def splitmix_draw(counter: Column, seed: int) -> Column:
    """Draw number ``counter`` (from 0) of the generator seeded with ``seed``: a struct of ``hi`` and ``lo``.

    The state only counts, so any draw is found without those before it.
    """
    turns = counter.cast("bigint") + F.lit(1)
    value = let(_halves(F.shiftright(turns, 32), turns), lambda a: _mul(a, GAMMA))
    value = let(value, lambda a: _add(a, seed))
    for by, factor in ((30, MIX_1), (27, MIX_2)):
        value = _step(value, by, factor)
    return let(value, lambda a: _xor_shift(a, 31))


def _step(value: Column, by: int, factor: int) -> Column:
    return let(let(value, lambda a: _xor_shift(a, by)), lambda a: _mul(a, factor))


def splitmix_index(counter: Column, length: Column, seed: int) -> Column:
    """Draw modulo ``length`` (below 2^31), unsigned."""
    n = length.cast("bigint")
    return let(splitmix_draw(counter, seed), lambda a: (a["hi"] % n * (_long(1 << 32) % n) + a["lo"] % n) % n)


MAX_DATASET_ROWS = 100_000  # the largest corpus that has a digest; its rows meet in one task


def _sorted_lines(rows: Column) -> Column:
    lines = F.array_join(F.sort_array(F.collect_list(rows)), "\n")
    return F.when(F.count(rows) <= MAX_DATASET_ROWS, lines).otherwise(F.raise_error(F.lit("a corpus of more than 100000 rows has no digest")).cast("string"))


def dataset_fingerprint(rows: Column) -> Column:
    """Aggregate: FNV-1a of a corpus' sorted row texts joined by line feeds, with its kind in front."""
    return F.concat(F.lit("fnv1a64:"), fnv1a64(_sorted_lines(rows), 0))


def dataset_sha256(rows: Column) -> Column:
    """Aggregate: SHA-256 of a corpus' sorted row texts joined by line feeds."""
    return F.sha2(_sorted_lines(rows), 256)


def valid_sha256(c: Column) -> Column:
    """Whether a text has the shape of a SHA-256 digest."""
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def valid_fingerprint(c: Column) -> Column:
    """Whether a text has the shape of a v1 fingerprint."""
    return F.coalesce(c.rlike(r"\Afnv1a64:[0-9a-f]{16}\z"), F.lit(False))
