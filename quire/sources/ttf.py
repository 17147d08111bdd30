"""TrueType files as glyph rows, and subsets of them."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.session import shipped


def tables(data: bytes) -> dict[str, bytes]:
    """The table directory: tag to bytes."""
    if len(data) < 12:
        raise ValueError("font file is too short")
    out = {}
    for i in range(struct.unpack_from(">H", data, 4)[0]):
        tag, _, offset, length = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        if offset + length > len(data):
            raise ValueError(f"table {tag!r} exceeds the file")
        out[tag.decode("latin-1")] = data[offset : offset + length]
    return out


def segments(sub: bytes) -> dict[int, int]:
    """Code points to glyphs of a segment subtable (format 4)."""
    n = struct.unpack_from(">H", sub, 6)[0] // 2
    column = lambda k, code=">%dH": struct.unpack_from(code % n, sub, 14 + 2 * n * k + (2 if k else 0))
    ends, starts, deltas, offsets = column(0), column(1), column(2, ">%dh"), column(3)
    base, out = 16 + 6 * n, {}
    for i, (a, b, delta, offset) in enumerate(zip(starts, ends, deltas, offsets)):
        for c in range(a, min(b, 0xFFFE) + 1):
            if offset:
                at = base + 2 * i + offset + 2 * (c - a)
                g = struct.unpack_from(">H", sub, at)[0] if at + 2 <= len(sub) else 0
                g = (g + delta) & 0xFFFF if g else 0
            else:
                g = (c + delta) & 0xFFFF
            if g:
                out[c] = g
    return out


def groups(sub: bytes) -> dict[int, int]:
    """Code points up to U+FFFF to glyphs of a group subtable (format 12)."""
    out = {}
    for i in range(struct.unpack_from(">I", sub, 12)[0]):
        a, b, g = struct.unpack_from(">III", sub, 16 + 12 * i)
        out.update((c, g + c - a) for c in range(a, min(b, 0xFFFF) + 1))
    return out


def characters(cmap: bytes) -> dict[int, int]:
    """The best Unicode subtable: full repertoire, then Windows' basic plane, then Unicode's own."""
    wanted = {(3, 10, 12): 3, (3, 1, 4): 2, (0, 3, 4): 1}
    best, found = 0, None
    for i in range(struct.unpack_from(">H", cmap, 2)[0]):
        platform, encoding, offset = struct.unpack_from(">HHI", cmap, 4 + 8 * i)
        form = struct.unpack_from(">H", cmap, offset)[0]
        if (score := wanted.get((platform, encoding, form), 0)) > best:
            best, found = score, (form, cmap[offset:])
    if not found:
        raise ValueError("no usable character map")
    return (groups if found[0] == 12 else segments)(found[1])


@dataclass
class Font:
    """What rendering needs of a font."""

    parts: dict[str, bytes]

    @classmethod
    def of(cls, data: bytes) -> Font:
        parts = tables(data)
        for tag in ("cmap", "head", "hhea", "hmtx"):
            if tag not in parts:
                raise ValueError(f"table {tag} is missing")
        return cls(parts)

    def __post_init__(self) -> None:
        self.units = struct.unpack_from(">H", self.parts["head"], 18)[0] or 1000
        self.box = struct.unpack_from(">4h", self.parts["head"], 36)
        self.ascent, self.descent = struct.unpack_from(">2h", self.parts["hhea"], 4)
        n = struct.unpack_from(">H", self.parts["hhea"], 34)[0]
        self.advances = [struct.unpack_from(">H", self.parts["hmtx"], 4 * i)[0] for i in range(n)]
        self.glyphs = characters(self.parts["cmap"])

    def advance(self, gid: int) -> int:
        """A glyph's width; glyphs beyond the table have the last one's."""
        return self.advances[min(gid, len(self.advances) - 1)] if self.advances else 0

    def bearing(self, gid: int) -> int:
        """A glyph's left side bearing; 0 where the table ends before it."""
        n, t = len(self.advances), self.parts["hmtx"]
        at = 4 * gid + 2 if gid < n else 4 * n + 2 * (gid - n)
        return struct.unpack_from(">h", t, at)[0] if at + 2 <= len(t) else 0

    def name(self) -> str:
        """The PostScript name, without spaces."""
        t = self.parts.get("name", b"")
        if len(t) >= 6:
            _, n, start = struct.unpack_from(">3H", t)
            for i in range(n):
                platform, _, _, key, length, offset = struct.unpack_from(">6H", t, 6 + 12 * i)
                if key == 6:
                    raw = t[start + offset : start + offset + length]
                    return raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace").replace(" ", "")
        return "Font"

    def hexed(self, text: str) -> str:
        return "".join("%04X" % self.glyphs.get(ord(c), 0) for c in text)

    def places(self) -> list[int]:
        """Where each glyph's outline starts, and where the last ends."""
        long = struct.unpack_from(">h", self.parts["head"], 50)[0]
        t = self.parts["loca"]
        return list(struct.unpack(f">{len(t) // 4}I", t)) if long else [2 * x for x in struct.unpack(f">{len(t) // 2}H", t)]

    def outline(self, gid: int) -> bytes:
        at = self.places()
        return self.parts["glyf"][at[gid] : at[gid + 1]] if gid + 1 < len(at) else b""

    def components(self, gid: int) -> list[int]:
        """The glyphs that a composite glyph is made of."""
        raw, out, at = self.outline(gid), [], 10
        if len(raw) < 12 or struct.unpack_from(">h", raw)[0] >= 0:
            return out
        while True:
            flags, part = struct.unpack_from(">HH", raw, at)
            out.append(part)
            at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 64 else 8 if flags & 128 else 0)
            if not flags & 32:
                return out

    def closure(self, gids: Iterable[int]) -> set[int]:
        """Glyphs with all that they are made of, and glyph 0."""
        found, todo = set(), [0, *gids]
        while todo:
            g = todo.pop()
            if g not in found:
                found.add(g)
                todo.extend(self.components(g))
        return found

    def subset(self, text: str) -> bytes:
        """A font that draws a text with the same glyph numbers; outlines of others are empty."""
        keep = self.closure(self.glyphs[ord(c)] for c in set(text) if ord(c) in self.glyphs)
        last = max(keep)
        glyf, loca = bytearray(), [0]
        for g in range(last + 1):
            raw = self.outline(g) if g in keep else b""
            glyf += raw + b"\0" * (-len(raw) % 4)
            loca.append(len(glyf))
        head = bytearray(self.parts["head"])
        struct.pack_into(">h", head, 50, 1)
        hhea = bytearray(self.parts["hhea"])
        struct.pack_into(">H", hhea, 34, last + 1)
        maxp = bytearray(self.parts["maxp"])
        struct.pack_into(">H", maxp, 4, last + 1)
        hmtx = b"".join(struct.pack(">Hh", self.advance(g), self.bearing(g)) for g in range(last + 1))
        own = {"glyf": bytes(glyf), "loca": struct.pack(f">{len(loca)}I", *loca), "head": bytes(head), "hhea": bytes(hhea), "maxp": bytes(maxp), "hmtx": hmtx}
        return assembled({**{t: self.parts[t] for t in ("cmap", "OS/2", "name", "post", "cvt ", "fpgm", "prep") if t in self.parts}, **own})


def subset_or_whole(data: bytes, text: str) -> bytes:
    """A subset for a text, or the file as it is where it can't be parsed."""
    try:
        return Font.of(data).subset(text)
    except (ValueError, KeyError, IndexError, struct.error):
        return data


def checksum(data: bytes) -> int:
    """The sum of big-endian 32-bit words, the last padded with zeros, modulo 2**32."""
    padded = data + b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


def assembled(parts: dict[str, bytes]) -> bytes:
    """A font file of tables, by tag, with its checksums."""
    head = bytearray(parts["head"])
    struct.pack_into(">I", head, 8, 0)
    parts = {**parts, "head": bytes(head)}
    n = len(parts)
    power = 1 << (n.bit_length() - 1)
    out = bytearray(struct.pack(">IHHHH", 0x00010000, n, power * 16, power.bit_length() - 1, (n - power) * 16))
    offset, body, at_head = 12 + 16 * n, bytearray(), 0
    for tag in sorted(parts):
        data = parts[tag]
        at_head = offset if tag == "head" else at_head
        out += struct.pack(">4sIII", tag.encode("latin-1"), checksum(data), offset, len(data))
        body += data + b"\0" * (-len(data) % 4)
        offset += len(data) + -len(data) % 4
    out += body
    struct.pack_into(">I", out, at_head + 8, (0xB1B0AFBA - checksum(bytes(out))) & 0xFFFFFFFF)
    return bytes(out)


def read_glyphs(files: DataFrame) -> DataFrame:
    """(path, content) -> font, code_point, gid, advance (in thousandths of an em); unreadable files give one row with an error."""
    shipped(files.sparkSession)
    schema = pa.schema([("font", pa.string()), ("code_point", pa.int32()), ("gid", pa.int32()), ("advance", pa.int32()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                try:
                    f = Font.of(content.as_py())
                    rows = [{"font": f.name(), "code_point": c, "gid": g, "advance": f.advance(g) * 1000 // f.units} for c, g in sorted(f.glyphs.items())]
                except (ValueError, struct.error, IndexError) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(work, "font string, code_point int, gid int, advance int, error string")
