"""Time, number and digest functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("long")


def unix_day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long")


def closed_hour(now: Column) -> Column:
    """The last closed hour at a time given in seconds."""
    return (F.floor(now / 3600) - 1).cast("long")


def as_of(hour: Column) -> Column:
    """The end of an hour, in seconds."""
    return (hour + 1) * 3600


def open_day(day: Column, now: Column, grace_minutes: int = 30) -> Column:
    """Today, or yesterday within the grace time."""
    today = F.floor(now / 86400)
    return (day == today) | ((day == today - 1) & (now % 86400 < grace_minutes * 60))


def latest_sealable(now: Column, grace_minutes: int = 30) -> Column:
    today = F.floor(now / 86400)
    return F.when(now % 86400 < grace_minutes * 60, today - 2).otherwise(today - 1).cast("long")


def coalescing_delay(age: Column, most: int, poll: int) -> Column:
    """What is left of the longest delay, at least a poll; a negative age counts as 0."""
    return F.greatest(F.lit(poll), F.lit(most) - F.greatest(age, F.lit(0)))


def parse_time(c: Column) -> Column:
    """RFC 3339 with or without a fraction; null if malformed."""
    return F.try_to_timestamp(c)


def unsigned_order(actor: Column) -> Column:
    """A key that sorts signed 64-bit patterns as unsigned."""
    return actor.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column by a constant key, as binary, from two plain digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)
    digest = lambda pad, m: F.unhex(F.sha2(F.concat(F.lit(pad), m), 256))
    return digest(outer, digest(inner, message))


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4(ip: Column) -> Column:
    """A dotted address as a number; null if it is none."""

    def number(parts):
        part = lambda i: F.get(parts, F.lit(i)).try_cast("long")
        total, sane = F.lit(0).cast("long"), F.size(parts) == 4
        for i in range(4):
            total, sane = total * 256 + part(i), sane & part(i).between(0, 255)
        return F.when(sane, total)

    return F.when(ip.rlike(r"^[0-9.]+$"), _let(F.split(ip, r"\."), number))


def ipv6(ip: Column) -> Column:
    """An address with colons as 32 hex digits; null if it is none. A dotted tail stands for the last two groups."""
    tail = F.regexp_extract(ip, r"([0-9]+\.[0-9.]+)$", 1)
    head = F.regexp_replace(ip, r"[0-9]+\.[0-9.]+$", "")
    dotted = _let(ipv4(tail), lambda low: F.concat(head, F.hex(F.floor(low / 65536).cast("long")), F.lit(":"), F.hex((low % 65536).cast("long"))))
    groups = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")

    def digits(plain):
        short = plain.contains("::")
        halves = F.struct(groups(F.substring_index(plain, "::", 1)).alias("a"), groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise("")).alias("b"))

        def filled(h):
            gap = F.lit(8) - F.size(h["a"]) - F.size(h["b"])
            every = F.concat(h["a"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), h["b"])
            sane = F.when(short, gap >= 1).otherwise(gap == 0) & F.forall(every, lambda x: F.length(x) <= 4)
            return F.when(sane, F.array_join(F.transform(every, lambda x: F.lpad(x, 4, "0")), ""))

        odd = plain.rlike(r"::.*::|:::|^:[^:]|[^:]:$")
        return F.when(plain.rlike(r"^[0-9a-f:]+$") & plain.contains(":") & ~odd, _let(halves, filled))

    return _let(F.lower(F.when(tail != "", dotted).otherwise(ip)), digits)


_MAPPED = "00000000000000000000ffff"


def _either(ip: Column, body) -> Column:
    """body(the address as an IPv4 number, as 32 hex digits of IPv6): one of them or none; a mapped address is IPv4."""

    def told(six):
        mapped = F.conv(F.substring(six, 25, 8), 16, 10).cast("long")
        both = F.struct(F.coalesce(ipv4(ip), F.when(six.startswith(_MAPPED), mapped)).alias("four"), F.when(~six.startswith(_MAPPED), six).alias("six"))
        return _let(both, lambda x: body(x["four"], x["six"]))

    return _let(ipv6(ip), told)


def actor_bytes(ip: Column) -> Column:
    """0x04 and the four bytes of an IPv4 address, 0x06 and the first eight of an IPv6 address; null for anything else."""
    return F.unhex(_either(ip, lambda four, six: F.coalesce(F.concat(F.lit("04"), F.lpad(F.hex(four), 8, "0")), F.concat(F.lit("06"), F.substring(six, 1, 16)))))


#: Address ranges that are not public.
RESERVED = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
            "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
            "::/128", "::1/128", "100::/64", "2001:2::/48", "2001:db8::/32", "2001:10::/28", "fc00::/7", "fe80::/10", "ff00::/8"]


def public_address(ip: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Whether an IPv4 or IPv6 address is in no reserved or blocked range; false for anything else."""
    import ipaddress


    def outside(four, six):
        out_4, out_6 = four.isNotNull(), six.isNotNull()
        for net in map(ipaddress.ip_network, [*RESERVED, *blocked]):
            first, last = int(net.network_address), int(net.broadcast_address)
            if net.version == 4:
                out_4 = out_4 & ~four.between(first, last)
            else:
                out_6 = out_6 & ~six.between(f"{first:032x}", f"{last:032x}")
        return F.coalesce(out_4, F.lit(False)) | F.coalesce(out_6, F.lit(False))

    return _either(ip, outside)


def sampled(key: Column, one_in: int) -> Column:
    """A fixed share of keys, the same on every run."""
    return F.pmod(F.xxhash64(key), F.lit(one_in)) == 0


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter with a quarter of room to spare."""
    import math

    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2 * 1.25)
    return bits, min(16, max(1, round(bits / n * math.log(2))))
