"""Elements are opaque bytes; everything here is a native, codegen-friendly column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the element hash: basis and prime. The basis is one digit shorter than
# the usual 64-bit FNV basis, so hashes differ from other FNV-1a implementations.
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211

#: The prime is 2**40 + 435; the product is done in 32-bit limbs, which ANSI arithmetic cannot overflow.
_LOW_MULTIPLIER = FNV_PRIME - 2**40
_MASK32 = 0xFFFFFFFF

# Fixed values of the segment geometry, in bytes.
HEADER_BYTES = 128
SLOT_BYTES = 8
RECORD_HEADER_BYTES = 16
PAGE_BYTES = 4096
SLOTS_ALIGN = 64
GROWTH = 4


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def element_of(*cols: Column | str) -> Column:
    """The UTF-8 bytes of the values joined by '/'. Not injective when values hold '/'."""
    return F.encode(F.concat_ws("/", *cols), "UTF-8")


def fingerprint(element: Column) -> Column:
    """64 hash bits of a binary column as BIGINT (two's complement)."""
    size = F.octet_length(element)
    positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(positions, lambda i: F.conv(F.hex(F.substring(element, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(state: Column, octet: Column) -> Column:
        mixed = state.bitwiseXOR(octet)
        low, high = mixed.bitwiseAND(_long(_MASK32)), F.shiftrightunsigned(mixed, 32)
        product = low * _long(_LOW_MULTIPLIER)
        carried = high * _long(_LOW_MULTIPLIER) + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.shiftleft(carried.bitwiseAND(_long(_MASK32)), 32).bitwiseOR(product.bitwiseAND(_long(_MASK32)))

    return F.aggregate(octets, _long(FNV_BASIS), step)


def used_fingerprint(element: Column) -> Column:
    """The hash with its low bit set: zero is reserved, and so every home slot is odd."""
    return fingerprint(element).bitwiseOR(_long(1))


def unsigned(bits: Column) -> Column:
    """Decimal text of a BIGINT read as an unsigned 64-bit value."""
    return F.conv(F.hex(bits), 16, 10)


def home_slot(used: Column, capacity: int) -> Column:
    return used.bitwiseAND(_long(capacity - 1))


def align_up(n: Column, a: int) -> Column:
    """n rounded up to a multiple of a (a power of two)."""
    return (n.cast("bigint") + _long(a - 1)).bitwiseAND(_long(-a))


def record_bytes(element: Column) -> Column:
    return align_up(F.octet_length(element) + F.lit(RECORD_HEADER_BYTES), 8)


def segment_file_bytes(capacity: Column, arena: Column) -> Column:
    slots_end = align_up(capacity * _long(SLOT_BYTES) + _long(HEADER_BYTES), SLOTS_ALIGN)
    return align_up(slots_end + arena, PAGE_BYTES)


def oversize(element: Column, max_bytes: int) -> Column:
    """True where a positive cap is exceeded; an element of exactly the cap is accepted."""
    return (F.octet_length(element) > F.lit(max_bytes)) if max_bytes > 0 else F.lit(False)
