"""Match predicates of the rule scan: ``match(operator, value, argument)`` as a boolean Column."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(v: Column, arg: str) -> Column:
    return v.rlike(arg)


def pm(v: Column, arg: str) -> Column:
    return contains_any(v, arg.split())


def contains_any(v: Column, phrases: list[str]) -> Column:
    """Any of the phrases, without case. The value is lowered once, not once per phrase."""
    words = F.array(*[F.lit(p.lower()) for p in phrases]) if phrases else F.array().cast("array<string>")
    return F.exists(
        F.transform(F.array(F.lower(v)), lambda low: F.exists(words, lambda w: F.contains(low, w))), lambda hit: hit
    )


def within(v: Column, arg: str) -> Column:
    return F.contains(F.lit(arg), v)


def streq(v: Column, arg: str) -> Column:
    return v == arg


def contains(v: Column, arg: str) -> Column:
    return v.contains(arg)


def ends_with(v: Column, arg: str) -> Column:
    return v.endswith(arg)


def begins_with(v: Column, arg: str) -> Column:
    return v.startswith(arg)


def _number(v: Column) -> Column:
    """Numeric value of a text; text that is no number counts as zero."""
    return F.coalesce(v.try_cast("long"), F.lit(0))


def eq(v: Column, arg: str) -> Column:
    return _number(v) == int(arg)


def lt(v: Column, arg: str) -> Column:
    return _number(v) < int(arg)


def gt(v: Column, arg: str) -> Column:
    return _number(v) > int(arg)


def ge(v: Column, arg: str) -> Column:
    return _number(v) >= int(arg)


def le(v: Column, arg: str) -> Column:
    return _number(v) <= int(arg)


def validate_byte_range(v: Column, arg: str) -> Column:
    """True when a byte lies outside the listed ranges (``9,10,32-126``).

    Bytes of 128 and up are those of characters beyond ASCII, so ranges that take all or none of them are tested on the
    text itself; other ranges are tested byte by byte.
    """
    allowed = set()
    for part in arg.split(","):
        low, _, high = part.strip().partition("-")
        allowed.update(range(int(low), int(high or low) + 1))
    upper = allowed & set(range(128, 256))
    spans = "".join(rf"\x{n:02x}" for n in sorted(allowed - upper))
    if len(upper) == 128:
        return v.rlike(rf"[^{spans}\x{{80}}-\x{{10FFFF}}]")
    if not upper:
        return v.rlike(f"[^{spans}]")
    spans += "".join(rf"\x{n:02x}" for n in sorted(upper))
    return F.decode(v.cast("binary"), "ISO-8859-1").rlike(f"[^{spans}]")


def validate_url_encoding(v: Column, _: str) -> Column:
    return v.rlike("%(?![0-9a-fA-F]{2})")


def validate_utf8(v: Column, _: str) -> Column:
    return ~F.is_valid_utf8(v)


#: How the digits of an IPv4 address begin that is written as IPv6.
MAPPED = "0" * 20 + "ffff"


def ipv4_number(v: Column) -> Column:
    part = lambda n: F.split_part(v, F.lit("."), F.lit(n)).try_cast("long")
    four = F.length(v) - F.length(F.replace(v, F.lit("."))) == 3
    inside = part(1).between(0, 255) & part(2).between(0, 255) & part(3).between(0, 255) & part(4).between(0, 255)
    return F.when(four & inside, ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def ipv6_digits(v: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, null for any other text; the last 32 bits may be written as IPv4."""
    tail = F.substring_index(v, ":", -1)
    number = ipv4_number(tail)
    spelled = F.concat(F.left(v, F.length(v) - F.length(tail)), F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(F.lit(65535))))
    v = F.when(v.contains(".") & v.contains(":"), spelled).otherwise(v)
    halves = F.split(F.lower(v), "::")
    groups = lambda part: F.filter(F.split(F.coalesce(part, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    padded = F.transform(F.concat(left, F.when(F.size(halves) == 2, zeros).otherwise(F.array().cast("array<string>")), right), lambda g: F.lpad(g, 4, "0"))
    whole = v.rlike("^[0-9a-fA-F:]*$") & v.contains(":") & (F.size(halves) <= 2) & (F.size(padded) == 8)
    return F.when(whole, F.array_join(padded, ""))


def ip_match(v: Column, arg: str) -> Column:
    """Address inside one of the listed networks: IPv4 by number, IPv6 by its digits; IPv4 mapped into IPv6 counts as IPv4."""
    digits, hit = ipv6_digits(v), F.lit(False)
    mapped = F.coalesce(digits.startswith(MAPPED), F.lit(False))
    number = F.when(mapped, F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long")).otherwise(ipv4_number(v))
    digits = F.when(~mapped, digits)
    for item in arg.split(","):
        net = ipaddress.ip_network(item.strip(), strict=False)
        if net.version == 6 and net.prefixlen >= 96 and net.network_address.ipv4_mapped:
            net = ipaddress.ip_network(f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}")
        low, high = int(net.network_address), int(net.broadcast_address)
        test = number.between(low, high) if net.version == 4 else digits.between(f"{low:032x}", f"{high:032x}")
        hit = hit | F.coalesce(test, F.lit(False))
    return hit


def unconditional(v: Column, _: str) -> Column:
    return F.lit(True)


PREDICATES: dict[str, Callable[[Column, str], Column]] = {
    "rx": rx,
    "pm": pm,
    "within": within,
    "streq": streq,
    "contains": contains,
    "endsWith": ends_with,
    "beginsWith": begins_with,
    "eq": eq,
    "lt": lt,
    "gt": gt,
    "ge": ge,
    "le": le,
    "validateByteRange": validate_byte_range,
    "validateUrlEncoding": validate_url_encoding,
    "validateUtf8Encoding": validate_utf8,
    "ipMatch": ip_match,
    "unconditionalMatch": unconditional,
}


def match(operator: str, value: Column, argument: str, negate: bool = False, phrases: dict[str, list[str]] | None = None) -> Column:
    """Predicate with a literal argument; null values never match."""
    if operator == "pmFromFile":
        words = [p for name in argument.split() for p in (phrases or {}).get(name, [])]
        hit = contains_any(value, words)
    elif operator in PREDICATES:
        hit = PREDICATES[operator](value, argument)
    else:
        raise ValueError(f"unknown operator: {operator}")
    return F.coalesce(~hit if negate else hit, F.lit(False)) & value.isNotNull()


def capture(value: Column, pattern: str, group: int) -> Column:
    """Group of a regular expression match, null without a match."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))
