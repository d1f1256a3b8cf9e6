import random

import pytest

from marlstone.sources import codecs as c

H = [bytes(range(20)), bytes(range(0xFF, 0xEB, -1))]
#: A batch of two hashes in the wire form, its digest and its signature.
GOLDEN = "4348485402000050ae0c02" + H[0].hex() + "0200000000000000010000000000000002" + "fffefdfcfbfaf9f8f7f6f5f4f3f2f1f0efeeedec" + "01000000000000002a"


def test_batch_has_the_wire_form():
    raw = c.encode_batch(20654, 12, [(H[1], 42), (H[0], 2), (H[0], 1), (H[0], 1)])
    assert raw.hex() == GOLDEN
    digest, signature = c.sign_batch(b"0123456789abcdef0123456789abcdef", "jp-crawler-01", 72623859790382856, 100, 103, raw)
    assert digest == "f9677f7b639d9e92f4a4d1710ca5aec8da298618ba8c5c27ae0274bb549f1369"
    assert signature == "f412c893652e24aa3999b4d42db2417764b17fc737a45675a502c0c8c8700a7e"
    assert c.decode_batch(raw) == (20654, 12, [(H[0], 1), (H[0], 2), (H[1], 42)])


def test_batch_keeps_unsigned_order_and_signed_patterns():
    raw = c.encode_batch(1, 0, [(H[0], -1), (H[0], 5)])
    assert c.decode_batch(raw)[2] == [(H[0], 5), (H[0], -1)]


@pytest.mark.parametrize("seed", range(40))
def test_damaged_batches_never_decode_to_the_same(seed):
    rnd, raw = random.Random(seed), bytearray.fromhex(GOLDEN)
    k = rnd.randrange(len(raw))
    raw[k] ^= 1 << rnd.randrange(8)
    try:
        assert c.decode_batch(bytes(raw)) != c.decode_batch(bytes.fromhex(GOLDEN))
    except c.FormatError:
        pass
    with pytest.raises(c.FormatError):
        c.decode_batch(bytes.fromhex(GOLDEN)[:-1])
    with pytest.raises(c.FormatError):
        c.decode_batch(bytes.fromhex(GOLDEN) + b"\0")


def test_varints_are_minimal():
    for n in (0, 127, 128, 1 << 32, c.MAX_U64):
        assert c.Cursor(c.put_uvarint(n)).uvarint() == n
    for bad in (b"\x80\x00", b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x02", b"\x80"):
        with pytest.raises(c.FormatError):
            c.Cursor(bad).uvarint()


def test_frames_round_trip_and_refuse_disorder():
    rows = [(0, 1), (1, 9), (64, 2), (70000, 5)]
    frames = c.encode_frames(rows)
    assert sorted(x for f in frames for x in c.decode_frame(*f)) == rows
    assert len(c.manifest_digest(738000, frames)) == 64
    with pytest.raises(c.FormatError):
        c.encode_frames([(5, 1), (5, 1)])


def test_details_do_not_depend_on_order():
    files, exts = [("a/b.txt", 3), ("a/a.txt", 4), ("a/a.txt", 1), ("é", 0)], [("txt", 3, 8), ("(none)", 1, 0)]
    raw = c.encode_detail(files, exts)
    assert raw == c.encode_detail(files[::-1], exts[::-1])
    got = c.decode_detail(raw)
    assert got == (sorted(files, key=lambda f: (f[0].encode(), f[1])), sorted(exts))


def test_actor_hours_round_trip():
    raw = c.encode_actor_hour(495000, 2, 2, 0, 1000, 1 << 20, 3, 1, [(H[1], 2), (H[0], 300)])
    head, rows = c.decode_actor_hour(raw)
    assert rows == [(H[0], 300), (H[1], 2)] and head["new_pairs"] == 302
    with pytest.raises(c.FormatError):
        c.decode_actor_hour(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_spool_tells_a_torn_tail_from_corruption():
    raw = c.encode_spool([b"one", b"", b"three"])
    assert c.decode_spool(raw) == ([b"one", b"", b"three"], False)
    assert c.decode_spool(raw[:-1]) == ([b"one", b""], True)
    with pytest.raises(c.FormatError):
        c.decode_spool(raw[:16] + b"x" + raw[17:])
    assert c.crc32c(b"123456789") == 0xE3069283


def test_bencode():
    value = {b"info": {b"name": b"x", b"length": 5, b"files": [{b"length": 2, b"path": [b"a", b"b.txt"]}]}, b"z": [1, -2, b""]}
    raw = c.bencode(value)
    assert c.bdecode(raw) == value
    assert c.metadata(raw)["files"] == [("a/b.txt", 2)]
    for bad in (b"i01e", b"i-0e", b"3:ab", b"d1:ae", b"le1", b"i5"):
        with pytest.raises(c.FormatError):
            c.bdecode(bad)


def test_compact_addresses_and_overlays():
    assert c.compact_peers(bytes([1, 2, 3, 4, 0, 80])) == [("1.2.3.4", 80)]
    assert c.compact_nodes(H[0] + bytes([1, 2, 3, 4, 0, 80]))[0] == (H[0], "1.2.3.4", 80)
    assert c.decode_overlay(b"M" + H[0] + b"R" + H[1]) == [("F", H[0]), ("R", H[1])]
    assert c.decode_log(c.encode_log([bytes([i]) * 28 for i in range(5)], 2)) == [bytes([i]) * 28 for i in range(5)]
