"""Providers of recognition, layout and translation, with retries and deterministic stubs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.layout import PAGE
from quire.session import shipped


class TextRecogniser(Protocol):
    def recognise(self, png: bytes, width: float, height: float, dpi: int) -> list[dict]: ...


class LayoutAnalyser(Protocol):
    def analyse(self, png: bytes, width: float, height: float, dpi: int) -> list[dict]: ...


#: Takes numbered blocks (id, text, type) and languages; returns the model's answer as text.
Model = Callable[[list[dict], str, str], str]

ATTEMPTS = 3
FIRST_PAUSE = 2.0
MOST_BODY = 50 << 20


class TooLarge(ValueError):
    """A service's answer exceeds the limit."""


def limited(body: bytes, most: int = MOST_BODY) -> bytes:
    if len(body) > most:
        raise TooLarge(f"answer of {len(body)} bytes exceeds {most}")
    return body


def multipart(image: bytes, boundary: str = "quire-boundary") -> tuple[bytes, str]:
    """A form with one PNG file, and its content type."""
    head = f'--{boundary}\r\nContent-Disposition: form-data; name="image"; filename="page.png"\r\nContent-Type: image/png\r\n\r\n'
    return head.encode() + image + f"\r\n--{boundary}--\r\n".encode(), f"multipart/form-data; boundary={boundary}"


def post_image(url: str, image: bytes, timeout: float = 120.0) -> dict:
    """Sends an image to a recognition service and returns its JSON; anything but status 200 is an error."""
    import urllib.request

    body, kind = multipart(image)
    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind}), timeout=timeout) as r:
        if r.status != 200:
            raise ValueError(f"service answered {r.status}: {r.read(512)!r}")
        found = json.loads(limited(r.read(MOST_BODY + 1)))
    if found.get("success") is False:
        raise ValueError("service reports a failure")
    return found


def json_array(answer: str) -> str:
    """The array in an answer, without code fences and prose."""
    s = answer.strip()
    if s.startswith("```"):
        s = s.removeprefix("```json").removeprefix("```")
        if "```" in s:
            s = s[: s.rindex("```")]
        s = s.strip()
    a, b = s.find("["), s.rfind("]")
    return s[a : b + 1] if 0 <= a < b else s


def strict_answers(answer: str, expected: int) -> list[str]:
    """An answer's texts: an array of strings or of objects with a text; any other form or length is an error."""
    found = json.loads(json_array(answer))
    if not isinstance(found, list):
        raise ValueError("not an array")
    texts = []
    for x in found:
        t = x.get("text") if isinstance(x, dict) else x
        if t is not None and not isinstance(t, str):
            raise ValueError("not a text")
        texts.append(t or "")
    if len(texts) != expected:
        raise ValueError(f"expected {expected} translations, got {len(texts)}")
    return texts


def attempted(call: Callable[[], list[str]], pause: Callable[[float], None] = time.sleep) -> list[str]:
    """The first of ATTEMPTS calls that succeeds, with doubling pauses between; the last error otherwise."""
    for i in range(ATTEMPTS):
        try:
            return call()
        except Exception:
            if i == ATTEMPTS - 1:
                raise
            pause(FIRST_PAUSE * 2**i)
    raise AssertionError("unreachable")


def translate_page(model: Model, blocks: list[dict], source: str, target: str, pause: Callable[[float], None] = time.sleep) -> list[str]:
    """All blocks of a page in one request; if that fails for good, each block by itself."""
    numbered = [{"id": i, "text": b["text"] if b["type"] == "table" else " ".join(b["text"].split()), **({"type": b["type"]} if b["type"] else {})} for i, b in enumerate(blocks)]
    try:
        return attempted(lambda: strict_answers(model(numbered, source, target), len(numbered)), pause)
    except Exception:
        return [attempted(lambda b=b: strict_answers(model([{**b, "id": 0}], source, target), 1), pause)[0] for b in numbered]


def stub_model(blocks: list[dict], source: str, target: str) -> str:
    return json.dumps([f"[{target}] {b['text']}" for b in blocks], ensure_ascii=False)


def translated_pages(blocks: DataFrame, model: Model, source: str, target: str) -> DataFrame:
    """Adds `translated` and `error` by one request per page; a page that fails keeps its error and its siblings go on.

    Blank blocks never reach the model. A page's blocks come as one row, so a lost executor
    repeats only the pages of its unfinished tasks.
    """
    shipped(blocks.sparkSession)
    wanted = blocks.filter(~is_blank(F.col("text")))
    packed = wanted.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("block_no", "text", F.coalesce("block_type", F.lit("")).alias("type")))).alias("b"))
    kinds = dict(packed.dtypes)
    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, t array<string>, error string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for page in b.column(2).to_pylist():
                try:
                    texts.append(translate_page(model, page, source, target))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.list_(pa.string())), pa.array(errors, pa.string())], ["doc_id", "page", "t", "error"])

    answers = packed.select(*PAGE, "b").mapInArrow(work, schema)
    numbers = packed.select(*PAGE, F.transform("b", lambda x: x["block_no"]).alias("n"))
    pairs = numbers.join(answers, list(PAGE)).select(*PAGE, "error", F.explode(F.arrays_zip("n", F.coalesce("t", F.transform("n", lambda _: F.lit(None).cast("string"))).alias("t"))).alias("z")).select(*PAGE, F.col("z.n").alias("block_no"), F.col("z.t").alias("translated"), "error")
    return blocks.join(pairs, [*PAGE, "block_no"], "left").withColumn("translated", F.when(is_blank(F.col("text")), F.col("text")).otherwise(F.col("translated")))
