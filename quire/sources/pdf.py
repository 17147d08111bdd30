"""PDF files as DataFrames of pages and spans: a subset (plain or Flate streams, classic or compressed objects, simple fonts and composite ones with a ToUnicode map)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import shipped

#: One object's next piece: a bracket, string, name, number or operator.
TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[-+]?\d*\.?\d+|[^\s<>\[\]()/%{}]+|[{}])", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes

    def data(self) -> bytes:
        kind = self.head.get("Filter")
        kinds = kind if isinstance(kind, list) else [kind] if kind else []
        out = self.raw
        for k in kinds:
            if k != "/FlateDecode":
                raise ValueError(f"unsupported filter {k}")
            out = zlib.decompressobj().decompress(out)
        return out


class Encrypted(ValueError):
    """The file is encrypted."""


def literal(raw: bytes) -> bytes:
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] in (b"\n", b"\r", b"\r\n") else ESCAPES.get(m[1], m[1]), raw, flags=re.S)


def parse(data: bytes, at: int = 0) -> tuple[Any, int]:
    """One object and where it ends. Names keep their slash; strings are bytes; operators are str with a leading dot."""
    m = TOKEN.match(data, at)
    if not m:
        raise ValueError(f"no object at {at}")
    t, end = m[1], m.end()
    if t == b"<<":
        out: dict[str, Any] = {}
        while TOKEN.match(data, end)[1] != b">>":
            key, end = parse(data, end)
            out[key[1:]], end = parse(data, end)
        return out, TOKEN.match(data, end).end()
    if t == b"[":
        items = []
        while TOKEN.match(data, end)[1] != b"]":
            item, end = parse(data, end)
            items.append(item)
        return items, TOKEN.match(data, end).end()
    if t[:1] == b"(":
        return literal(t[1:-1]), end
    if t[:1] == b"<":
        digits = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end
    if t[:1] == b"/":
        return t.decode("latin-1"), end
    if re.fullmatch(rb"\d+", t) and (r := re.compile(rb"\s+\d+\s+R\b").match(data, end)):
        return Ref(int(t)), r.end()
    if re.fullmatch(rb"[-+]?\d+", t):
        return int(t), end
    if re.fullmatch(rb"[-+]?\d*\.\d+|[-+]?\d+\.", t):
        return float(t), end
    return {b"true": True, b"false": False, b"null": None}.get(t, "." + t.decode("latin-1")), end


@dataclass
class Pdf:
    """A file's objects by number; the last definition of a number counts."""

    data: bytes
    objects: dict[int, Any] = field(default_factory=dict)
    root: Any = None

    def __post_init__(self) -> None:
        if not self.data.lstrip().startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", self.data):
            try:
                value, end = parse(self.data, m.end())
            except (ValueError, TypeError):
                continue
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream\r?\n").match(self.data, end)):
                size = value.get("Length")
                stop = s.end() + size if isinstance(size, int) else -1
                if stop < 0 or not re.compile(rb"\s*endstream").match(self.data, stop):
                    stop = self.data.index(b"endstream", s.end())
                value = Stream(value, self.data[s.end() : stop])
            self.objects[int(m[1])] = value
        heads = [parse(self.data, m.end())[0] for m in re.finditer(rb"\btrailer\b", self.data)]
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.head.get("Type") == "/XRef":
                heads.append(value.head)
            if isinstance(value, Stream) and value.head.get("Type") == "/ObjStm":
                body, first = value.data(), value.head["First"]
                numbers = list(map(int, body[:first].split()))
                for n, offset in zip(numbers[::2], numbers[1::2]):
                    self.objects.setdefault(n, parse(body, first + offset)[0])
        if any("Encrypt" in h for h in heads):
            raise Encrypted("the file is encrypted")
        self.root = next((h["Root"] for h in reversed(heads) if "Root" in h), None)

    def get(self, x: Any) -> Any:
        while isinstance(x, Ref):
            x = self.objects.get(x.number)
        return x

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def visit(ref: Any, inherited: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref.number in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref.number)
            own = inherited | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    visit(kid, own)
            else:
                out.append(own | node)

        root = self.get(self.root)
        if isinstance(root, dict):
            visit(root.get("Pages"), {})
        return out

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(p.data() for p in parts if isinstance(p, Stream))


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """The transformation that applies `m`, then `n`."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def unicode_entries(cmap: bytes) -> dict[int, str]:
    """The entries of a ToUnicode map: single characters and ranges."""
    out: dict[int, str] = {}
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", cmap, re.S):
        items, at = [], 0
        while TOKEN.match(body, at):
            item, at = parse(body, at)
            items.append(item)
        if kind == b"bfchar":
            out.update((int.from_bytes(c, "big"), t.decode("utf-16-be", "replace")) for c, t in zip(items[::2], items[1::2]))
            continue
        for first, last, t in zip(items[::3], items[1::3], items[2::3]):
            a, b = int.from_bytes(first, "big"), min(int.from_bytes(last, "big"), 0xFFFF)
            for i in range(b - a + 1):
                if isinstance(t, bytes):
                    out[a + i] = (t[:-2] + ((int.from_bytes(t[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
                elif i < len(t):
                    out[a + i] = t[i].decode("utf-16-be", "replace")
    return out


@dataclass
class Face:
    """What reading text needs of a font: its codes' characters, and their widths in thousandths of an em."""

    wide: bool = False
    chars: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    width: float = 500.0

    @classmethod
    def of(cls, pdf: Pdf, font: Any) -> Face:
        """Fonts without widths get half an em a character; a map that can't be read counts as none."""
        font = pdf.get(font)
        if not isinstance(font, dict):
            return cls()
        try:
            cmap = pdf.get(font.get("ToUnicode"))
            chars = unicode_entries(cmap.data()) if isinstance(cmap, Stream) else {}
        except (ValueError, TypeError, AttributeError, zlib.error):
            chars = {}
        if font.get("Subtype") != "/Type0":
            first, given = pdf.get(font.get("FirstChar")) or 0, pdf.get(font.get("Widths")) or []
            return cls(False, chars, {first + i: float(w) for i, x in enumerate(given) if isinstance(w := pdf.get(x), int | float)})
        inner = pdf.get((pdf.get(font.get("DescendantFonts")) or [None])[0]) or {}
        todo, widths = [pdf.get(x) for x in pdf.get(inner.get("W")) or []], {}
        while len(todo) > 1:
            if isinstance(todo[1], list):
                widths.update((todo[0] + i, float(pdf.get(w))) for i, w in enumerate(todo[1]))
                todo = todo[2:]
            else:
                widths.update((c, float(todo[2])) for c in range(todo[0], min(todo[1], 0xFFFF) + 1))
                todo = todo[3:]
        return cls(True, chars, widths, float(pdf.get(inner.get("DW", 1000))))

    def read(self, raw: bytes) -> tuple[str, float]:
        """The text of a shown string, and its width in ems."""
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.wide else list(raw)
        other = (lambda c: "\ufffd") if self.wide else (lambda c: bytes([c]).decode("cp1252", "replace"))
        return "".join(self.chars[c] if c in self.chars else other(c) for c in codes), sum(self.widths.get(c, self.width) for c in codes) / 1000


def faces(pdf: Pdf, page: dict) -> dict[str, Face]:
    """The fonts of a page by their resource names."""
    resources = pdf.get(page.get("Resources"))
    fonts = pdf.get(resources.get("Font")) if isinstance(resources, dict) else None
    return {name: Face.of(pdf, font) for name, font in fonts.items()} if isinstance(fonts, dict) else {}


def spans(content: bytes, fonts: dict[str, Face] | None = None) -> list[dict]:
    """Shown strings with their places on the page, and the sizes that `Tf` names; a new line begins where y changes.

    Text and page transformations move and scale the places. Spacing, clipping and forms drawn by `Do` are left out of account.
    """
    fonts, out, stack, at, saved = fonts or {}, [], [], 0, []
    ctm = line = place = UNIT
    font, size, leading = "", 0.0, 0.0

    def show(raw: bytes) -> None:
        nonlocal place
        text, ems = fonts.get(font, Face()).read(raw)
        start = times(place, ctm)
        place = times((1, 0, 0, 1, ems * size, 0), place)
        if text:
            out.append({"text": text, "x": start[4], "y": start[5], "end_x": times(place, ctm)[4], "font": font, "font_size": size})

    def down(x: float, y: float) -> None:
        nonlocal line, place
        line = place = times((1, 0, 0, 1, x, y), line)

    while m := TOKEN.match(content, at):
        value, at = parse(content, at)
        if not (isinstance(value, str) and value.startswith(".")):
            stack.append(value)
            continue
        op, args = value[1:], stack
        stack = []
        try:
            if op == "BT":
                line = place = UNIT
            elif op == "q":
                saved.append((ctm, font, size, leading))
            elif op == "Q":
                ctm, font, size, leading = saved.pop()
            elif op == "cm":
                ctm = times(tuple(map(float, args[-6:])), ctm)
            elif op == "Tf":
                font, size = args[-2][1:], float(args[-1])
            elif op == "TL":
                leading = float(args[-1])
            elif op in ("Td", "TD"):
                leading = -args[-1] if op == "TD" else leading
                down(args[-2], args[-1])
            elif op == "Tm":
                line = place = times(tuple(map(float, args[-6:])), UNIT)
            elif op == "T*":
                down(0, -leading)
            elif op == "Tj":
                show(args[-1])
            elif op in ("'", '"'):
                down(0, -leading)
                show(args[-1])
            elif op == "TJ":
                for x in args[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        place = times((1, 0, 0, 1, -x / 1000 * size, 0), place)
        except (IndexError, TypeError, ValueError):
            continue
    return out


PAGES = "path string, page_num int, total_pages int, width double, height double, page_text string, error string, spans array<struct<line_no:int,span_no:int,text:string,x:double,y:double,end_x:double,font:string,font_size:double>>"


def read_pages(data: bytes) -> list[dict]:
    pdf = Pdf(data)
    pages = pdf.pages()
    out = []
    for i, page in enumerate(pages):
        box = [pdf.get(v) for v in (pdf.get(page.get("MediaBox")) or [])]
        w, h = (float(box[2] - box[0]), float(box[3] - box[1])) if len(box) >= 4 else (612.0, 792.0)
        try:
            found, error = spans(pdf.content(page), faces(pdf, page)), None
        except (ValueError, zlib.error) as e:
            found, error = [], str(e)
        line = n = 0
        for j, s in enumerate(found):
            if j and abs(s["y"] - found[j - 1]["y"]) > 1e-6:
                line, n = line + 1, 0
            s |= {"line_no": line, "span_no": n}
            n += 1
        out.append({"page_num": i + 1, "total_pages": len(pages), "width": w, "height": h, "page_text": " ".join(s["text"] for s in found), "error": error, "spans": found})
    return out


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of each PDF under a path; files that can't be read give one row with an error and no page."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """(path, content) -> PAGES. One file at a time is held in memory."""
    shipped(files.sparkSession)
    names = [x.split()[0] for x in ("path", "page_num", "total_pages", "width", "height", "page_text", "error", "spans")]
    span = pa.struct([("line_no", pa.int32()), ("span_no", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("end_x", pa.float64()), ("font", pa.string()), ("font_size", pa.float64())])
    schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.list_(span)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                try:
                    rows = read_pages(content.as_py())
                except (ValueError, KeyError, IndexError, TypeError, zlib.error) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **r} for r in rows], schema)

    return files.mapInArrow(work, PAGES)
