"""The runtime's hash functions as column expressions.

Spark's long arithmetic raises on overflow, so 64-bit state is kept as two 32-bit halves.  Those expressions fold over
bytes and are interpreted; `djb2_fast`, `djb2_id`, `hash64_fast` and `digest_hex` are the same functions over Arrow
batches, one step for each byte position, for plans that hash many keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash functions.
SEED = 5381
PRIME1 = 0x9E3779B185EBCA87
PRIME2 = 0xC2B2AE3D27D4EB4F
PRIME3 = 0x165667B19E3779F9
PRIME5 = 0x27D4EB2F165667C5
SECOND_SEED = 0x517CC1B727220A95

LOW = 0xFFFFFFFF


def octets(data: Column) -> Column:
    """The bytes of a string (UTF-8) or binary column as an array of one-character strings, U+0000 to U+00FF."""
    chars = F.split(F.decode(data.cast("binary"), "ISO-8859-1"), "")
    return F.filter(chars, lambda c: c != "")


def fold(data: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Left fold of `step(state, byte)` over the bytes of `data`."""
    return F.aggregate(octets(data), start, lambda h, c: step(h, F.ascii(c).cast("long")))


def halves(hi, lo) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return F.struct(as_column(hi).alias("hi"), as_column(lo).alias("lo"))


def constant(value: int) -> Column:
    return halves(value >> 32, value & LOW)


def as_long(h: Column) -> Column:
    """The 64 bits as a signed long."""
    return F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])


def as_hex(h: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def positive(h: Column) -> Column:
    """The 64 bits without the sign bit, as a long."""
    return F.shiftleft(h["hi"].bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(h["lo"])


def djb2(data: Column) -> Column:
    """32-bit djb2 of the bytes, as a long in [0, 2^32)."""
    return fold(data, F.lit(SEED).cast("long"), lambda h, b: (h * 33 + b).bitwiseAND(LOW))


def djb2_64(data: Column, seed: Column | None = None) -> Column:
    """64-bit djb2 as halves, from `seed` (halves) or the usual start."""

    def step(h: Column, b: Column) -> Column:
        low = h["lo"] * 33 + b
        return halves((h["hi"] * 33 + F.shiftright(low, 32)).bitwiseAND(LOW), low.bitwiseAND(LOW))

    return fold(data, constant(SEED) if seed is None else seed, step)


def _times32(a: Column, b: int) -> Column:
    """a * b mod 2^32 for a, b below 2^32."""
    return (a.bitwiseAND(0xFFFF) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW)


def times(h: Column, by: int) -> Column:
    """h * by mod 2^64."""
    by_hi, by_lo = by >> 32, by & LOW
    p0, p1 = h["lo"].bitwiseAND(0xFFFF) * by_lo, F.shiftright(h["lo"], 16) * by_lo
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    return halves((carry + _times32(h["lo"], by_hi) + _times32(h["hi"], by_lo)).bitwiseAND(LOW), low.bitwiseAND(LOW))


def xor(a: Column, b: Column) -> Column:
    return halves(a["hi"].bitwiseXOR(b["hi"]), a["lo"].bitwiseXOR(b["lo"]))


def right(h: Column, n: int) -> Column:
    """h >> n, unsigned, 0 < n <= 63."""
    if n >= 32:
        return halves(0, F.shiftright(h["hi"], n - 32))
    return halves(F.shiftright(h["hi"], n), F.shiftright(h["lo"], n).bitwiseOR(F.shiftleft(h["hi"], 32 - n).bitwiseAND(LOW)))


def rotate(h: Column, n: int) -> Column:
    """h rotated left by n < 32."""
    left = lambda a, b: F.shiftleft(a, n).bitwiseOR(F.shiftright(b, 32 - n)).bitwiseAND(LOW)
    return halves(left(h["hi"], h["lo"]), left(h["lo"], h["hi"]))


def named(h: Column, f: Callable[[Column], Column]) -> Column:
    """f(h), with h evaluated once."""
    return F.element_at(F.transform(F.array(h), f), 1)


def hash64(data: Column) -> Column:
    """The 64-bit mixing hash as halves."""
    length = F.octet_length(data).cast("long") + (PRIME5 & LOW)
    start = halves((F.shiftright(length, 32) + (PRIME5 >> 32)).bitwiseAND(LOW), length.bitwiseAND(LOW))
    by_byte = [(b * PRIME5) & ((1 << 64) - 1) for b in range(256)]
    high, low = (F.array(*(F.lit(x).cast("long") for x in part)) for part in ([v >> 32 for v in by_byte], [v & LOW for v in by_byte]))
    mixed = fold(data, start, lambda h, b: named(rotate(xor(h, halves(F.get(high, b.cast("int")), F.get(low, b.cast("int")))), 11), lambda r: times(r, PRIME1)))
    mixed = named(named(mixed, lambda h: xor(h, right(h, 33))), lambda h: times(h, PRIME2))
    mixed = named(named(mixed, lambda h: xor(h, right(h, 29))), lambda h: times(h, PRIME3))
    return named(mixed, lambda h: xor(h, right(h, 32)))


def fold_numpy(values: list[bytes], start: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Left folds of `step(states, bytes)` over many byte strings at once: one step for each byte position.

    Positions are read off the joined bytes, longest strings first, so one long string costs no padding of the others.
    """
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.frombuffer(b"".join(values) or b"\0", np.uint8)
    order = np.argsort(-size, kind="stable")
    at, h = (np.cumsum(size) - size)[order], start[order]
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # strings longer than each position
    for k, n in enumerate(live.tolist()):
        h[:n] = step(h[:n], flat[at[:n] + k].astype(np.uint64))
    out = np.empty_like(h)
    out[order] = h
    return out


def hash64_numpy(values: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, values), np.uint64, len(values))

    def step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = h ^ b * np.uint64(PRIME5)
        return ((x << np.uint64(11)) | (x >> np.uint64(53))) * np.uint64(PRIME1)

    h = fold_numpy(values, np.uint64(PRIME5) + size, step)
    h ^= h >> np.uint64(33)
    h *= np.uint64(PRIME2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(PRIME3)
    return h ^ (h >> np.uint64(32))


def djb2_numpy(values: list[bytes], seed: int = SEED) -> np.ndarray:
    """64-bit djb2; its low half is the 32-bit one."""
    return fold_numpy(values, np.full(len(values), seed, np.uint64), lambda h, b: h * np.uint64(33) + b)


def encoded(keys: pd.Series) -> list[bytes]:
    return ["".encode() if k is None else k.encode("utf-8", "replace") for k in keys]


def djb2_fast(data: Column) -> Column:
    """djb2 of strings; null stays null."""

    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series((djb2_numpy(encoded(keys)) & np.uint64(LOW)).astype(np.int64)).where(keys.notna().to_numpy())

    return hashed(data.cast("string"))


def djb2_id(data: Column) -> Column:
    """64-bit djb2 of binaries without the sign bit, as a long; null stays null."""

    @F.pandas_udf("long")
    def hashed(keys: pd.Series) -> pd.Series:
        ids = djb2_numpy([b"" if k is None else bytes(k) for k in keys]) & np.uint64((1 << 63) - 1)
        return pd.Series(pd.arrays.IntegerArray(ids.astype(np.int64), keys.isna().to_numpy()))

    return hashed(data)


def hash64_hex(data: Column) -> Column:
    """hash64 of strings as sixteen lower-case hex digits; null stays null."""

    @F.pandas_udf("string")
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series([f"{h:016x}" for h in hash64_numpy(encoded(keys)).tolist()]).where(keys.notna().to_numpy(), None)

    return hashed(data.cast("string"))


def hash64_fast(key: Column) -> Column:
    """hash64 of strings with the sign bit flipped, so that signed order is the unsigned order of the hashes."""

    @F.pandas_udf("long")
    def scored(keys: pd.Series) -> pd.Series:
        return pd.Series((hash64_numpy([k.encode("utf-8", "replace") for k in keys]) ^ np.uint64(1 << 63)).view(np.int64))

    return scored(key)


def digest_hex(data: Column) -> Column:
    """The 32-digit key digest of strings: two 64-bit hashes, one after the other (not cryptographic); null stays null."""

    @F.pandas_udf("string")
    def hashed(keys: pd.Series) -> pd.Series:
        raw = encoded(keys)
        both = zip(hash64_numpy(raw).tolist(), djb2_numpy(raw, SECOND_SEED).tolist())
        return pd.Series([f"{a:016x}{b:016x}" for a, b in both]).where(keys.notna().to_numpy(), None)

    return hashed(data.cast("string"))


def persisted_request_id(entity_type: Column, entity_id: Column, tag: Column, key: Column) -> Column:
    """The deterministic request id of an address, a tag and key bytes."""
    nul = F.unhex(F.lit("00"))
    part = lambda c: c.cast("binary")
    return djb2_id(F.concat(part(entity_type), nul, part(entity_id), nul, part(tag), nul, part(key)))


def fallback_reply_id(request_id: Column, sequence: Column) -> Column:
    """The reply id of a request and a sequence: over 8 and 4 big-endian bytes."""
    wide = F.unhex(F.lpad(F.hex(request_id.cast("long")), 16, "0"))
    narrow = F.unhex(F.lpad(F.hex(sequence.cast("long").bitwiseAND(LOW)), 8, "0"))
    return djb2_id(F.concat(wide, narrow))


def journal_key(name: Column, key: Column, entity_type: Column, entity_id: Column) -> Column:
    return F.concat(F.lit("__journal/"), persisted_request_id(entity_type, entity_id, F.concat(F.lit("__journal/"), name), key).cast("string"))
