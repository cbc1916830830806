"""IP addresses as bit strings, so that range membership is equality of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.once import computed_once

IPV4 = 32
IPV6 = 128

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_FULL = "^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
_SHORTENED = f"^(?:{_GROUPS})?::(?:{_GROUPS})?$"


def family(address: Column) -> Column:
    """32 or 128, by the presence of a colon."""
    return F.when(F.contains(address, F.lit(":")), F.lit(IPV6)).otherwise(F.lit(IPV4))


def _octets(quad: Column) -> Column:
    return F.split(quad, r"\.")


def _number(octets: Column) -> Column:
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("bigint")
    return number


def _hex_to_bits(digits: Column) -> Column:
    def half(start: int) -> Column:
        return F.lpad(F.conv(F.substring(digits, start, 16), 16, 2), 64, "0")

    return F.concat(half(1), half(17))


def with_address_bits(df: DataFrame, address: str, bits: str = "bits") -> DataFrame:
    """Append ``bits``: 32 or 128 characters of 0 and 1, NULL for an invalid address.

    IPv6 goes through a few named steps so that each is computed once; rows holding an IPv4
    address skip them.
    """
    kept = [F.col(f"`{name}`") for name in df.columns]
    text = F.col(f"`{address}`")

    is_ipv6 = F.contains(text, F.lit(":"))
    # Checked before any conversion: converting garbage gives zeros, not NULL.
    octets = F.when(~is_ipv6 & text.rlike(f"^{_QUAD}$"), _octets(text))
    lower = F.when(is_ipv6, F.lower(text))
    quad = F.regexp_extract(lower, f":({_QUAD})$", 1)
    quad_hex = F.lpad(F.hex(_number(_octets(quad))), 8, "0")
    plain = F.when(
        F.contains(lower, F.lit(".")) & (quad != ""),
        F.concat(
            F.substring(lower, F.lit(1), F.length(lower) - F.length(quad)),
            F.lower(F.substring(quad_hex, 1, 4)),
            F.lit(":"),
            F.lower(F.substring(quad_hex, 5, 4)),
        ),
    ).otherwise(lower)
    step = df.select(*kept, octets.alias("_octets"), plain.alias("_plain"))

    # Every group as exactly four digits.
    zeros = F.regexp_replace("_plain", "([0-9a-f]+)", "000$1")
    wide = F.regexp_replace(zeros, "[0-9a-f]*([0-9a-f]{4})", "$1")
    step = step.select(*kept, "_octets", "_plain", wide.alias("_wide"))

    def side(part: int) -> Column:
        return F.replace(F.split_part("_wide", F.lit("::"), F.lit(part)), F.lit(":"), F.lit(""))

    step = step.select(
        *kept, "_octets", "_plain", side(1).alias("_left"), side(2).alias("_right")
    )

    given = F.length("_left") + F.length("_right")
    digits = F.when(F.col("_plain").rlike(_FULL), F.col("_left")).when(
        F.col("_plain").rlike(_SHORTENED) & (given <= 28),
        F.concat("_left", F.expr("repeat('0', 32 - length(_left) - length(_right))"), "_right"),
    )
    step = step.select(*kept, "_octets", digits.alias("_digits"))

    ipv4 = F.when(F.col("_octets").isNotNull(), F.lpad(F.bin(_number(F.col("_octets"))), IPV4, "0"))
    value = F.when(is_ipv6, _hex_to_bits(F.col("_digits"))).otherwise(ipv4)
    return computed_once(step, df.columns, **{bits: value})


def with_cidr_parts(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Append ``addr``, ``len``, ``family`` and ``net_bits`` of ``addr/len`` texts.

    An address alone has all its bits as length. ``net_bits`` is NULL if the address or the length is
    invalid.
    """
    text = F.col(f"`{cidr}`")
    addr = F.split_part(text, F.lit("/"), F.lit(1))
    given = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int")
    length = F.when(F.contains(text, F.lit("/")), given).otherwise(family(addr))
    parts = df.select("*", addr.alias("addr"), length.alias("len"), family(addr).alias("family"))
    parts = with_address_bits(parts, "addr", "_bits")
    usable = F.col("len").between(0, F.col("family"))
    net_bits = F.when(usable, F.substring(F.col("_bits"), F.lit(1), F.col("len")))
    return parts.select("*", net_bits.alias("net_bits")).drop("_bits")


def point_of(bits: Column) -> Column:
    """An address's bits as a value of an order in which ranges are half-open intervals: one more bit in front leaves
    room for the end of a range that holds the last address."""
    return F.concat(F.lit("0"), bits)


def _filled(net_bits: Column, size: Column, bit: str) -> Column:
    return F.rpad(net_bits, size, F.lit(bit))


def interval_of(net_bits: Column, size: Column) -> tuple[Column, Column]:
    """The first point of a range, and the first behind it. ``size`` is that of the family."""
    ones = F.rtrim(F.concat(F.lit("0"), _filled(net_bits, size, "1")), F.lit("1"))
    kept = F.length(ones) - 1
    end = F.rpad(F.concat(F.substring(ones, F.lit(1), kept), F.lit("1")), size + 1, F.lit("0"))
    return point_of(_filled(net_bits, size, "0")), end


def blocks_of(low: Column, end: Column, size: Column) -> Column:
    """The fewest prefixes that make up an interval of points, as an array of bit strings.

    Below the prefix that its first and last address share, the first address's side needs a prefix for itself and one for each 0 in
    it, turned to 1; the last address's side one for itself and one for each 1, turned to 0.
    """
    first = F.substring(low, F.lit(2), size)
    ones = F.rtrim(end, F.lit("0"))
    last = F.concat(F.substring(ones, F.lit(1), F.length(ones) - 1), F.lit("0"))
    last = F.substring(F.rpad(last, size + 1, F.lit("1")), F.lit(2), size)
    sides = F.array(F.struct(first.alias("first"), last.alias("last"), size.alias("size")))

    def split(pair: Column) -> Column:
        differs = F.zip_with(F.split(pair["first"], ""), F.split(pair["last"], ""), lambda a, b: a != b)
        at = F.array_position(differs, True).cast("int")
        return F.struct(pair["first"].alias("first"), pair["last"].alias("last"), pair["size"].alias("size"), at.alias("at"))

    def side(text: Column, at: Column, trimmed: str, other: str) -> Column:
        short = F.rtrim(text, F.lit(trimmed))
        own = F.substring(text, F.lit(1), F.greatest(F.length(short), at))
        behind = F.filter(
            F.sequence(at, F.length(own)), lambda i: (i > at) & (F.substring(own, i, F.lit(1)) == trimmed)
        )
        return F.concat(F.array(own), F.transform(behind, lambda i: F.concat(F.substring(own, F.lit(1), i - 1), F.lit(other))))

    def blocks(pair: Column) -> Column:
        at = pair["at"]
        shared = F.substring(pair["first"], F.lit(1), F.greatest(at - 1, F.lit(0)))
        whole = (_filled(shared, pair["size"], "0") == pair["first"]) & (_filled(shared, pair["size"], "1") == pair["last"])
        return (
            F.when(at == 0, F.array(pair["first"]))
            .when(whole, F.array(shared))
            .otherwise(F.concat(side(pair["first"], at, "0", "1"), side(pair["last"], at, "1", "0")))
        )

    return F.flatten(F.transform(F.transform(sides, split), blocks))


def cidr_text(net_bits: Column, size: Column) -> Column:
    """``addr/len`` of a prefix; IPv6 as eight groups without leading zeros."""
    whole = _filled(net_bits, size, "0")

    def parts(n: int, width: int, base: int, mark: str) -> Column:
        places = F.array(*[F.lit(1 + i * width) for i in range(n)])
        return F.array_join(F.transform(places, lambda at: F.lower(F.conv(F.substring(whole, at, F.lit(width)), 2, base))), mark)

    text = F.when(size == IPV4, parts(4, 8, 10, ".")).otherwise(parts(8, 16, 16, ":"))
    return F.concat(text, F.lit("/"), F.length(net_bits).cast("string"))
