"""Guard for outbound URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host names that must not be called; the same as numbers for IPv4.
BLOCKED_HOSTS = ("localhost", "::1")
BLOCKED_IPV4 = (0x7F000001, 0)
_LOOPBACK_V6 = r"^(0{0,4}:){2,7}0{0,3}1$"


def _number(part: Column) -> Column:
    """An IPv4 part in decimal, octal or hexadecimal digits, or NULL."""
    return (
        F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 20)), 16, 10))
        .when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
        .when(part.rlike("^(0|[1-9][0-9]*)$"), part)
        .try_cast("bigint")
    )


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is worked out once, however often it is used there."""
    return F.transform(F.array(value), of)[0]


def url_guard(url: Column) -> Column:
    """Reason a URL is refused: 'invalid', 'protocol', 'host', 'private', or 'ok'.

    Hosts are read as a browser does: user and port are left out, backslashes
    count as slashes, and a host that ends in a number is an IPv4 address, with
    up to four parts in any base, the last of which fills the remaining bytes.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def guarded(clean: Column) -> Column:
        scheme = F.lower(F.nullif(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))
        authority = F.regexp_extract(clean, r"^[^:]*:[/\\]*([^/\\?#]*)", 1)
        place = F.regexp_replace(authority, "^.*@", "")
        return _let(scheme, lambda scheme: (
            F.when(scheme.isNull(), "invalid").when(~scheme.isin("http", "https"), "protocol").otherwise(_let(place, _place_guard))
        ))

    return _let(clean, guarded)


def _place_guard(place: Column) -> Column:
    in_brackets = place.startswith("[")
    host = F.lower(F.when(in_brackets, F.regexp_extract(place, r"^\[([0-9A-Fa-f:.]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*)(.*)$", 1)
    good_port = lambda port: (
        port.rlike("^(:[0-9]*)?$") & (F.coalesce(F.nullif(F.substring(port, 2, 30), F.lit("")).try_cast("bigint"), F.lit(0)) <= 65535)
    )
    good_host = lambda host: (host != "") & (in_brackets | ~host.rlike(r"[\x00-\x20<>^|%\[\]\x7f]"))

    def guarded(host: Column) -> Column:
        parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
        is_ipv4 = lambda parts: ~in_brackets & F.element_at(parts, -1).rlike("^([0-9]+|0[xX][0-9a-fA-F]*)$")
        return (
            F.when(~(good_host(host) & _let(port, good_port)), "invalid")
            .when(host.isin(*BLOCKED_HOSTS) | in_brackets & host.rlike(_LOOPBACK_V6), "host")
            .otherwise(_let(parts, lambda parts: F.when(is_ipv4(parts), _let(F.transform(parts, _number), _ipv4_guard)).otherwise("ok")))
        )

    return _let(host, guarded)


def _ipv4_guard(numbers: Column) -> Column:
    n = F.size(numbers)
    last = F.element_at(numbers, -1)
    fits = (
        (n <= 4)
        & F.forall(numbers, lambda x: x.isNotNull())
        & F.forall(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), lambda x: x <= 255)
        & (last < F.pow(F.lit(256.0), 5 - n))
    )
    upper = F.aggregate(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    address = (upper * F.pow(F.lit(256.0), 5 - n)).cast("bigint") + last

    def guarded(address: Column) -> Column:
        a, b = F.shiftright(address, 24), F.shiftright(address, 16).bitwiseAND(255)
        private = (
            (a == 10)
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | ((a == 169) & (b == 254))
            | (a == 0)
        )
        return F.when(address.isin(*BLOCKED_IPV4), "host").when(private, "private").otherwise("ok")

    return F.when(~F.coalesce(fits, F.lit(False)), "invalid").otherwise(_let(address, guarded))
