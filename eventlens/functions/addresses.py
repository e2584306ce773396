"""Internet addresses and networks of both families as sortable keys.

A key is 32 hexadecimal digits, the 16 bytes of an IPv6 address; IPv4 addresses have the key of their mapped form
(::ffff:a.b.c.d), so both spellings of one address are equal. Keys compare as the numbers do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 128
MAPPED = "00000000000000000000ffff"
DIGITS = "0123456789abcdef"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"({OCTET}\.){{3}}{OCTET}"


def _dotted_hex(text: Column) -> Column:
    """Eight digits of a dotted IPv4 address."""
    return F.concat_ws("", F.transform(F.split(text, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")))


def address_key(address: Column) -> Column:
    """Key of an IPv4 or IPv6 address; NULL for anything else (octets with leading zeros and zones among it)."""
    text = F.lower(F.trim(address.cast("string")))
    # a dotted ending counts as two groups
    tail = F.regexp_extract(text, rf"(?<=:)({DOTTED})$", 1)
    ending = _dotted_hex(tail)
    groups = F.when(tail == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(ending, 1, 4), F.lit(":"), F.substring(ending, 5, 4)))
    halves = F.split(groups, "::")
    wide = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    short = F.size(halves) == 2
    left, right = wide(F.get(halves, F.lit(0))), F.when(short, wide(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    given = F.size(left) + F.size(right)
    group = "[0-9a-f]{1,4}"
    shape = groups.rlike(rf"^(({group}(:{group})*)?::({group}(:{group})*)?|{group}(:{group}){{7}})$")
    good = shape & F.when(short, given <= 7).otherwise(given == 8)
    six = F.concat(F.concat_ws("", left), F.repeat(F.lit("0000"), 8 - given), F.concat_ws("", right))
    return F.when(text.rlike(f"^{DOTTED}$"), F.concat(F.lit(MAPPED), _dotted_hex(text))).when(good, six)


def _nibble(digit: Column) -> Column:
    return F.instr(F.lit(DIGITS), digit) - 1


def masked(key: Column, length: Column, fill: str) -> Column:
    """The first (`fill` "0") or last ("f") key of the network of `length` bits around a key."""
    whole = (length / 4).cast("int")
    digit = _nibble(F.substring(key, whole + 1, F.lit(1)))
    span = F.element_at(F.array(*[F.lit(s) for s in (16, 8, 4, 2)]), (length % 4).cast("int") + 1)
    cut = digit - digit % span + (span - 1 if fill == "f" else F.lit(0))
    part = F.when(length % 4 == 0, F.lit("")).otherwise(F.substring(F.lit(DIGITS), cut.cast("int") + 1, F.lit(1)))
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole), part), 32, fill)


def network_parts(network: Column) -> tuple[Column, Column]:
    """Key and length in bits (of 128) of `address/length` or a single address; both NULL if it is neither."""
    text = F.trim(network.cast("string"))
    key = address_key(F.substring_index(text, "/", 1))
    size = F.when(text.contains(":"), F.lit(BITS)).otherwise(F.lit(32))
    given = F.when(text.contains("/"), F.when(text.rlike("^[^/]+/[0-9]{1,3}$"), F.substring_index(text, "/", -1).cast("int"))).otherwise(size)
    length = F.when(key.isNotNull() & (given <= size), given + (BITS - size))
    return F.when(length.isNotNull(), key), length


def next_key(key: Column) -> Column:
    """The key after this one; NULL after the last."""
    kept = F.rtrim(key, F.lit("f"))
    n = F.length(kept)
    raised = F.translate(F.substring(kept, n, F.lit(1)), DIGITS[:-1], DIGITS[1:])
    return F.when(n > 0, F.rpad(F.concat(F.substring(kept, F.lit(1), n - 1), raised), 32, "0"))
