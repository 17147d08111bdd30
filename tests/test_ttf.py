"""Font files made here, read back and subset."""

import struct

from quire.sources import ttf


def cmap4(pairs):
    """A segment subtable with a segment per character."""
    rows = [(c, c, (g - c) & 0xFFFF) for c, g in sorted(pairs.items())] + [(0xFFFF, 0xFFFF, 1)]
    n = len(rows)
    pack = lambda k: struct.pack(f">{n}H", *[r[k] for r in rows])
    body = struct.pack(">HHHH", 2 * n, 0, 0, 0) + pack(1) + b"\0\0" + pack(0) + pack(2) + b"\0\0" * n
    return struct.pack(">HHH", 4, 6 + len(body), 0) + body


def font():
    simple = struct.pack(">h4h", 1, 0, 0, 10, 10) + b"\x00\x00" + b"outline-data"
    composite = struct.pack(">h4h", -1, 0, 0, 10, 10) + struct.pack(">HHbb", 0x20, 1, 0, 0) + struct.pack(">HHhh", 0x01, 2, 0, 0)
    glyf, loca = b"", [0]
    for g in (b"", simple, simple, composite, simple):
        glyf += g + b"\0" * (-len(g) % 4)
        loca.append(len(glyf))
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 2000)
    struct.pack_into(">h", head, 50, 1)
    hhea = bytearray(36)
    struct.pack_into(">2h", hhea, 4, 900, -200)
    struct.pack_into(">H", hhea, 34, 3)
    name = "My Font".encode("utf-16-be")
    sub = cmap4({65: 1, 66: 3, 0x20AC: 4})
    return ttf.assembled(
        {
            "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub,
            "head": bytes(head),
            "hhea": bytes(hhea),
            "maxp": struct.pack(">IH", 0x00010000, 5) + b"\0" * 26,
            "hmtx": b"".join(struct.pack(">Hh", w, 0) for w in (500, 1200, 700)),
            "name": struct.pack(">3H", 0, 1, 18) + struct.pack(">6H", 3, 1, 0, 6, len(name), 0) + name,
            "loca": struct.pack(">6I", *loca),
            "glyf": glyf,
        }
    )


def test_read():
    f = ttf.Font.of(font())
    assert f.glyphs == {65: 1, 66: 3, 0x20AC: 4}
    assert (f.units, f.ascent, f.descent, f.name()) == (2000, 900, -200, "MyFont")
    assert [f.advance(g) for g in range(5)] == [500, 1200, 700, 700, 700]
    assert f.hexed("AB€?") == "0001000300040000"
    assert f.components(3) == [1, 2] and f.closure([3]) == {0, 1, 2, 3}
    assert ttf.checksum(font()) == 0xB1B0AFBA


def test_subset():
    f = ttf.Font.of(font())
    s = ttf.Font.of(f.subset("B"))
    assert s.hexed("B") == "0003" and s.closure([3]) == {0, 1, 2, 3}
    assert all(s.outline(g) == f.outline(g) for g in range(4)) and s.outline(4) == b""
    only = ttf.Font.of(f.subset("A"))
    assert only.outline(1) == f.outline(1) and len(only.advances) == 2


def test_groups():
    sub = struct.pack(">HHIII", 12, 0, 28 + 12, 0, 2) + struct.pack(">III", 97, 99, 5) + struct.pack(">III", 0x1F600, 0x1F601, 9)
    assert ttf.groups(sub) == {97: 5, 98: 6, 99: 7}


def test_glyph_rows(spark):
    rows = ttf.read_glyphs(spark.createDataFrame([("a", bytearray(font())), ("b", bytearray(b"no font"))], "path string, content binary")).collect()
    assert [(r.code_point, r.gid, r.advance) for r in rows if r.error is None] == [(65, 1, 600), (66, 3, 350), (0x20AC, 4, 350)]
    assert sum(r.error is not None for r in rows) == 1
