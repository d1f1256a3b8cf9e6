"""Binary formats at the engine's edges, in plain Python, and the readers that decode files of them in bulk.

Each decoder accepts only the canonical form. Inside the engine the data are columns.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
import zlib

#: Marks, versions and sizes of the formats.
BATCH_MAGIC, BATCH_VERSION = b"CHHT", 2
SPOOL_MAGIC, SPOOL_VERSION, SPOOL_HEAD, SPOOL_MOST = b"CHR1", 1, 16, 4 << 20
SHARDS = 64
ACTOR_HOUR_MAGIC, ACTOR_HOUR_VERSION = b"CHAH", 1
DETAIL_VERSION = 1
OVERLAY_RECORD = 21
MAX_U64 = (1 << 64) - 1


class FormatError(ValueError):
    """Bytes that are not the canonical form."""


def need(ok: bool, why: str) -> None:
    if not ok:
        raise FormatError(why)


def put_uvarint(n: int) -> bytes:
    need(0 <= n <= MAX_U64, "out of range")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class Cursor:
    """Reads bytes in turn."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        need(self.at + n <= len(self.raw), "truncated")
        self.at += n
        return self.raw[self.at - n : self.at]

    def fixed(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def uvarint(self) -> int:
        total = 0
        for k in range(10):
            b = self.take(1)[0]
            total |= (b & 127) << 7 * k
            if b < 128:
                need(k == 0 or b != 0, "a varint is not minimal")
                need(total <= MAX_U64, "a varint overflows")
                return total
        raise FormatError("a varint is too long")

    def end(self) -> None:
        need(self.at == len(self.raw), "trailing bytes")


# Heat batches: groups of (hash, actors), both strictly ascending.


def encode_batch(day: int, hour: int, pairs) -> bytes:
    groups: dict[bytes, set[int]] = {}
    for h, actor in pairs:
        need(len(h) == 20, "a hash has 20 bytes")
        groups.setdefault(bytes(h), set()).add(actor & MAX_U64)
    need(bool(groups) and 0 <= hour <= 23, "no pairs, or no such hour")
    out = [BATCH_MAGIC, bytes([BATCH_VERSION]), struct.pack(">IB", day, hour), put_uvarint(len(groups))]
    for h in sorted(groups):
        out += [h, put_uvarint(len(groups[h])), *(struct.pack(">Q", a) for a in sorted(groups[h]))]
    return b"".join(out)


def decode_batch(raw: bytes, most: int = 10_000_000) -> tuple[int, int, list[tuple[bytes, int]]]:
    """(day, hour, pairs); actors as signed 64-bit patterns."""
    c = Cursor(raw)
    need(c.take(4) == BATCH_MAGIC and c.fixed("B") == BATCH_VERSION, "not a heat batch of this version")
    day, hour = c.fixed(">I"), c.fixed("B")
    need(hour <= 23, "no such hour")
    groups, last, pairs = c.uvarint(), None, []
    need(0 < groups <= most, "number of groups")
    for _ in range(groups):
        h = c.take(20)
        need(last is None or last < h, "hashes are not strictly ascending")
        last, n, before = h, c.uvarint(), -1
        need(0 < n and len(pairs) + n <= most, "number of actors")
        for _ in range(n):
            actor = c.fixed(">Q")
            need(actor > before, "actors are not strictly ascending")
            before = actor
            pairs.append((h, actor - (1 << 64) if actor >> 63 else actor))
    c.end()
    return day, hour, pairs


def sign_batch(secret: bytes, crawler: str, epoch: int, first: int, last: int, raw: bytes) -> tuple[str, str]:
    """(SHA-256 of the payload, HMAC over prefix and payload), in hex."""
    digest = hashlib.sha256(raw).hexdigest()
    prefix = f"CHHT/2\n{crawler}\n{epoch}\n{first}\n{last}\n{digest}\n".encode()
    return digest, hmac.new(secret, prefix + raw, hashlib.sha256).hexdigest()


# Day frames: per shard, differences of id >> 6 and counts.


def encode_frames(entries) -> list[tuple[int, int, bytes]]:
    """(shard, entries, payload) of all shards from (id, count) in strictly ascending order."""
    out, last, n, seen = [bytearray() for _ in range(SHARDS)], [0] * SHARDS, [0] * SHARDS, -1
    for i, count in entries:
        need(i > seen and count > 0, "ids ascend strictly and counts are positive")
        seen, s = i, i & 63
        out[s] += put_uvarint((i >> 6) - last[s]) + put_uvarint(count)
        last[s] = i >> 6
        n[s] += 1
    return [(s, n[s], bytes(out[s])) for s in range(SHARDS)]


def decode_frame(shard: int, entries: int, raw: bytes) -> list[tuple[int, int]]:
    need(0 <= shard < SHARDS and entries >= 0, "shard or number of entries")
    c, q, out = Cursor(raw), 0, []
    for k in range(entries):
        step = c.uvarint()
        need(k == 0 or step > 0, "ids do not ascend")
        q += step
        count = c.uvarint()
        need(count > 0 and q <= ((1 << 63) - 1) >> 6, "an entry is out of bounds")
        out.append((q << 6 | shard, count))
    c.end()
    return out


def manifest_digest(day_number: int, frames: list[tuple[int, int, bytes]]) -> str:
    """SHA-256 over the day and each shard's number, entries and payload digest. day_number counts from 0001-01-01."""
    need(len(frames) == SHARDS, "a manifest has all shards")
    out = hashlib.sha256(struct.pack(">i", day_number))
    for shard, n, raw in sorted(frames):
        out.update(struct.pack(">hi", shard, n) + hashlib.sha256(raw).digest())
    return out.hexdigest()


# Details: files with prefix-compressed paths, and extensions.


def shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def encode_detail(files, extensions) -> bytes:
    """files: (path, length); extensions: (name, files, bytes). Sorted by bytes, so the form does not depend on order."""
    named = sorted((p.encode(), n) for p, n in files)
    exts = sorted((e.encode(), n, b) for e, n, b in extensions)
    need(all(p and n >= 0 for p, n in named) and all(e and n > 0 and b >= 0 for e, n, b in exts), "an entry is out of bounds")
    need(len({e for e, _, _ in exts}) == len(exts), "extensions repeat")
    out, last = [bytes([DETAIL_VERSION]), put_uvarint(len(named))], b""
    for p, n in named:
        k = shared_prefix(last, p)
        out += [put_uvarint(k), put_uvarint(len(p) - k), p[k:], put_uvarint(n)]
        last = p
    out.append(put_uvarint(len(exts)))
    for e, n, b in exts:
        out += [put_uvarint(len(e)), e, put_uvarint(n), put_uvarint(b)]
    return b"".join(out)


def decode_detail(raw: bytes) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
    c = Cursor(raw)
    need(c.fixed("B") == DETAIL_VERSION, "not a detail of this version")
    files, last = [], b""
    for k in range(c.uvarint()):
        n = c.uvarint()
        need(n <= len(last), "a prefix is longer than the last path")
        path = last[:n] + c.take(c.uvarint())
        need(path and n == shared_prefix(last, path) and (k == 0 or path >= last), "paths are not canonical")
        size = c.uvarint()
        need(k == 0 or (path, size) >= (last, files[-1][1]) or path > last, "paths are not in order")
        files.append((path.decode(), size))
        last = path
    extensions, before = [], b""
    for _ in range(c.uvarint()):
        name = c.take(c.uvarint())
        need(name > before, "extensions are not in order")
        before = name
        extensions.append((name.decode(), c.uvarint(), c.uvarint()))
    c.end()
    return files, extensions


# Actor-hour frames: a header, hashes with shared prefixes and counts, and a checksum.


def encode_actor_hour(unix_hour: int, state: int, coverage: int, reasons: int, fp_ppm: int, capacity: int, duplicates: int, bypassed: int, entries) -> bytes:
    rows = sorted((bytes(h), n) for h, n in entries)
    need(all(len(h) == 20 and n > 0 for h, n in rows) and len({h for h, _ in rows}) == len(rows), "entries")
    head = struct.pack(">BBBBqIIQQQQI", ACTOR_HOUR_VERSION, state, coverage, 0, unix_hour, reasons, fp_ppm, capacity, sum(n for _, n in rows), duplicates, bypassed, len(rows))
    out, last = [ACTOR_HOUR_MAGIC, head], bytes(20)
    for h, n in rows:
        k = shared_prefix(last, h)
        out += [bytes([k]), h[k:], put_uvarint(n)]
        last = h
    body = b"".join(out)
    return body + hashlib.sha256(body).digest()


def decode_actor_hour(raw: bytes) -> tuple[dict, list[tuple[bytes, int]]]:
    need(len(raw) > 32 and hashlib.sha256(raw[:-32]).digest() == raw[-32:], "checksum")
    c = Cursor(raw[:-32])
    need(c.take(4) == ACTOR_HOUR_MAGIC, "not an actor-hour frame")
    kind = ">BBBBqIIQQQQI"
    version, state, coverage, zero, hour, reasons, fp, capacity, new, dup, bypassed, n = struct.unpack(kind, c.take(struct.calcsize(kind)))
    need(version == ACTOR_HOUR_VERSION and zero == 0, "version")
    rows, last = [], bytes(20)
    for k in range(n):
        p = c.fixed("B")
        need(p <= 20, "a prefix is too long")
        h = last[:p] + c.take(20 - p)
        need(p == shared_prefix(last, h) and (k == 0 or h > last), "hashes are not canonical")
        count = c.uvarint()
        need(count > 0, "a count is 0")
        rows.append((h, count))
        last = h
    c.end()
    need(sum(x for _, x in rows) == new, "counts do not add up to the new pairs")
    return {"unix_hour": hour, "state": state, "coverage": coverage, "reasons": reasons, "fp_ppm": fp, "capacity": capacity, "new_pairs": new, "duplicates": dup, "bypassed": bypassed}, rows


# Spool segments: framed payloads with CRC-32C.

_CRC = []
for _n in range(256):
    for _ in range(8):
        _n = _n >> 1 ^ (0x82F63B78 if _n & 1 else 0)
    _CRC.append(_n)


def crc32c(raw: bytes) -> int:
    c = 0xFFFFFFFF
    for b in raw:
        c = c >> 8 ^ _CRC[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def encode_spool(payloads) -> bytes:
    return b"".join(SPOOL_MAGIC + struct.pack(">HHII", SPOOL_VERSION, 0, len(p), crc32c(p)) + p for p in payloads)


def decode_spool(raw: bytes) -> tuple[list[bytes], bool]:
    """(payloads, torn): a frame cut short at the end is a torn tail; anything else wrong is corruption."""
    out, at = [], 0
    while at < len(raw):
        if at + SPOOL_HEAD > len(raw):
            return out, True
        magic, (version, _, n, crc) = raw[at : at + 4], struct.unpack_from(">HHII", raw, at + 4)
        need(magic == SPOOL_MAGIC and version == SPOOL_VERSION and n <= SPOOL_MOST, "a frame's head is corrupt")
        if at + SPOOL_HEAD + n > len(raw):
            return out, True
        p = raw[at + SPOOL_HEAD : at + SPOOL_HEAD + n]
        need(crc32c(p) == crc, "a frame's checksum is wrong")
        out.append(p)
        at += SPOOL_HEAD + n
    return out, False


def encode_log(records, per_frame: int = 10_000) -> bytes:
    """Append log: zlib frames of 28-byte records, each with its length and CRC-32."""
    out = []
    for k in range(0, len(records), per_frame):
        z = zlib.compress(b"".join(records[k : k + per_frame]), 1)
        out.append(struct.pack(">II", len(z), zlib.crc32(z)) + z)
    return b"".join(out)


def decode_log(raw: bytes, width: int = 28) -> list[bytes]:
    out, at = [], 0
    while at + 8 <= len(raw):
        n, crc = struct.unpack_from(">II", raw, at)
        z = raw[at + 8 : at + 8 + n]
        if len(z) < n or zlib.crc32(z) != crc:
            break  # a torn tail
        body = zlib.decompress(z)
        out += [body[i : i + width] for i in range(0, len(body), width)]
        at += 8 + n
    return out


def decode_overlay(raw: bytes) -> list[tuple[str, bytes]]:
    """(kind, hash) of 21-byte records; M is an old F."""
    need(len(raw) % OVERLAY_RECORD == 0, "a record is cut short")
    out = []
    for at in range(0, len(raw), OVERLAY_RECORD):
        kind = {"M": "F"}.get(k := chr(raw[at]), k)
        need(kind in "FSHR", "no such kind")
        out.append((kind, raw[at + 1 : at + OVERLAY_RECORD]))
    return out


# Bencode and compact addresses.


def bdecode(raw: bytes):
    value, at = _bvalue(raw, 0, 0)
    need(at == len(raw), "trailing bytes")
    return value


def _bvalue(raw: bytes, at: int, depth: int):
    need(depth < 64 and at < len(raw), "nested too deep, or truncated")
    mark = raw[at : at + 1]
    if mark == b"i":
        end = raw.find(b"e", at)
        need(end > 0, "truncated")
        digits = raw[at + 1 : end].decode("ascii", "replace")
        need(digits.lstrip("-").isdigit() and str(int(digits)) == digits, "an integer is not canonical")
        return int(digits), end + 1
    if mark in (b"l", b"d"):
        items, at = [], at + 1
        while raw[at : at + 1] != b"e":
            item, at = _bvalue(raw, at, depth + 1)
            items.append(item)
        if mark == b"l":
            return items, at + 1
        need(len(items) % 2 == 0 and all(isinstance(k, bytes) for k in items[::2]), "a dictionary's keys")
        return dict(zip(items[::2], items[1::2])), at + 1
    colon = raw.find(b":", at)
    need(colon > 0 and raw[at:colon].isdigit(), "not a value")
    n = int(raw[at:colon])
    need(colon + 1 + n <= len(raw), "truncated")
    return raw[colon + 1 : colon + 1 + n], colon + 1 + n


def bencode(x) -> bytes:
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, (bytes, str)):
        x = x.encode() if isinstance(x, str) else x
        return b"%d:" % len(x) + x
    if isinstance(x, dict):
        pairs = sorted((k.encode() if isinstance(k, str) else k, v) for k, v in x.items())
        return b"d" + b"".join(bencode(k) + bencode(v) for k, v in pairs) + b"e"
    return b"l" + b"".join(map(bencode, x)) + b"e"


def info_hash(raw: bytes) -> str:
    """SHA-1 of the canonical bytes of a metadata file's info dictionary."""
    return hashlib.sha1(bencode(bdecode(raw)[b"info"])).hexdigest()


def metadata(raw: bytes) -> dict:
    """Name, total length and files of a metadata file; padding files do not count, and an empty list is refused."""
    info = bdecode(raw)[b"info"]
    name = (info.get(b"name.utf-8") or info.get(b"name") or b"").decode("utf-8", "replace").strip()
    files = [("/".join(p.decode("utf-8", "replace") for p in f.get(b"path.utf-8") or f[b"path"]), f[b"length"]) for f in info.get(b"files", [])]
    files = [f for f in files if not f[0].rsplit("/", 1)[-1].startswith("_____padding_file_")]
    if b"files" not in info:
        files = [(name, info[b"length"])]
    need(bool(files), "no files")
    return {"name": name, "total_length": sum(n for _, n in files), "files": files}


def compact_peers(raw: bytes) -> list[tuple[str, int]]:
    need(len(raw) % 6 == 0, "a peer has 6 bytes")
    return [(".".join(map(str, raw[i : i + 4])), int.from_bytes(raw[i + 4 : i + 6], "big")) for i in range(0, len(raw), 6)]


def compact_nodes(raw: bytes) -> list[tuple[bytes, str, int]]:
    need(len(raw) % 26 == 0, "a node has 26 bytes")
    return [(raw[i : i + 20], *compact_peers(raw[i + 20 : i + 26])[0]) for i in range(0, len(raw), 26)]
