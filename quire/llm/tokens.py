"""Token counts by heap-and-linked-list byte-pair merging, and token ids for packing."""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column, read, replaced, shipped

VOCABULARY = "word_bpe_49k.json"
#: A worker forgets what it has counted when it holds this many words, and never keeps longer ones than
#: this many characters, so its memory is bounded; the counts don't depend on it.
CACHE, LONGEST = 500_000, 40
#: Unicode's white space, which Python's split() takes together with four control characters.
BLANK = re.compile("[%s]+" % "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
CONTROLS = [chr(c) for c in range(28, 32)]
#: Below this, characters have no composed forms or classes that differ between Unicode versions.
PLAIN = chr(0x250)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WIDE = re.compile("[^%s-%s]" % (chr(0), chr(0x24F)))


def pieces_of(text: str) -> list[str]:
    """The runs of a text between white space; no token spans two of them."""
    if any(c in text for c in CONTROLS):
        return [x for x in BLANK.split(text) if x]
    return text.split()


class Memo(dict):
    """What a function gave for each of the short words it met last; emptied when full. Longer words are computed each time."""

    def __init__(self, make: Callable[[str], Any]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> Any:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of a word-level BPE file without making identifiers.

    A word's symbols form a linked list. A heap holds adjacent pairs by rank and place; the
    lowest is popped, joined if both its symbols are still there, and its new neighbours are
    pushed. The count is the number of symbols less the number of merges. Joined symbols are
    named by their merge's number.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.number: dict[str, int] = {}
        for s in self.symbols.values():
            for x in (s, s + self.end):
                self.number.setdefault(x, len(self.number))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            made = self.number.setdefault(a + b, len(self.number))
            self.merges[self.number[a], self.number[b]] = rank, made
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(special)) if special else None
        self.first = {t["content"][:2] for t in spec["added_tokens"] if t["special"]}
        self.back = {s: b for b, s in self.symbols.items()}
        self.words = Memo(self.word)
        self.runs = Memo(lambda run: sum(map(self.words.__getitem__, self.split.findall(run))))
        self.odd = Memo(self.run)

    def merged(self, symbols: list[int]) -> int:
        """How many tokens are left of a word's symbols."""
        n = count = len(symbols)
        if n < 2:
            return n
        get, heap = self.merges.get, []
        after, before, at = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        for i in range(n - 1):
            if found := get((at[i], at[i + 1])):
                heap.append((found[0], i, at[i], at[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if at[i] != a or j >= n or at[j] != b:
                continue
            at[i], at[j] = made, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := get((made, at[k])):
                    heapq.heappush(heap, (found[0], i, made, at[k], found[1]))
            if (h := before[i]) >= 0 and (found := get((at[h], made))):
                heapq.heappush(heap, (found[0], h, at[h], made, found[1]))
        return count

    def word(self, word: str) -> int:
        """Tokens of a word in normal form."""
        names = [self.symbols[b] for b in word.encode("utf-8")]
        names[-1] += self.end
        return self.merged([self.number[x] for x in names])

    def run(self, run: str) -> int:
        """Tokens of a run in any script, by the library's own normal form and classes of characters."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return sum(self.words[bytes(self.back[c] for c in w).decode("utf-8")] for w, _ in found if w)

    def plain(self, text: str) -> int:
        if WIDE.search(text):
            return sum(map(self.odd.__getitem__, pieces_of(text)))
        return sum(map(self.runs.__getitem__, pieces_of(text.lower())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(x in text for x in self.first) and self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens of each whole text.

    Null and empty texts have 0 of both. Special strings inside a text count as one token each,
    as is the library's default. Each row is counted alone, without a shuffle; a worker keeps
    the counts of at most CACHE words of LONGEST characters. Input columns named like an added one are replaced.
    """
    path = path or vocabulary_path()
    shipped(docs.sparkSession)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.count(x.as_py()) for x in texts], pa.int64())

    docs = replaced(docs, "n_bytes", "n_tokens")
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens(text)})


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole `documents`: null and empty texts have none, repeated rows are each counted."""
    rows = count_tokens(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


class Encoder:
    """The library's ids of whole texts, put together from those of their words, which are kept for reuse."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.code = "I" if self.library.get_vocab_size() > 1 << 16 else "H"
        self.wide = {"I": "<u4", "H": "<u2"}[self.code]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.model = self.library.model
        self.symbols = byte_symbols()
        self.odd = Memo(self.encoded)
        self.runs = Memo(self.run)

    def encoded(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """A word in normal form goes straight to the library's model, as its bytes' stand-ins."""
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
        return self.packed([t.id for t in self.model.tokenize(word)])

    def run(self, run: str) -> bytes:
        """A run is one word or several, which are runs themselves."""
        if not run.isalpha():
            words = self.split.findall(run)
            if len(words) > 1:
                return b"".join(map(self.runs.__getitem__, words))
        return self.word(run)

    def packed(self, numbers: list[int]) -> bytes:
        ids = array(self.code, numbers)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def usual(self, text: str) -> bool:
        """Whether a text's runs are those between its white space once it is in lower case."""
        return not (any(x in text for x in self.special) or WIDE.search(text) or any(c in text for c in CONTROLS))

    def unusual(self, text: str) -> bytes:
        """The ids of any text by itself."""
        if any(x in text for x in self.special):
            return self.encoded(text)
        if WIDE.search(text):
            return b"".join(map(self.odd.__getitem__, pieces_of(text)))
        return b"".join(map(self.runs.__getitem__, pieces_of(text.lower())))

    def ids(self, texts: pa.Array, end: int) -> pa.Array:
        """Each text's ids and `end` as little-endian numbers of `wide`; null is empty.

        Arrow splits the texts and numbers their distinct runs, so each is looked up once for all
        texts and the ids are put together by these numbers. An unusual text counts as one run.
        """
        lower, whole = [], {}
        for i, text in enumerate(texts.to_pylist()):
            text = text or ""
            if self.usual(text):
                lower.append(text.lower())
            else:
                lower.append("")
                whole[i] = self.unusual(text)
        split = pc.utf8_split_whitespace(pa.array(lower, pa.string()))
        runs = split.flatten().dictionary_encode()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False)
        known = [*map(self.runs.__getitem__, distinct), np.array([end], self.wide).tobytes(), *whole.values()]
        # behind a text's runs come its own ids, if it is unusual, and the end
        rows = np.concatenate([np.fromiter(whole, np.int64, len(whole)), np.arange(len(lower))])
        added = np.concatenate([np.arange(len(distinct) + 1, len(known)), np.full(len(lower), len(distinct))])
        ends = split.offsets.to_numpy()[1:]
        numbers = np.insert(runs.indices.to_numpy(), ends[rows], added)
        last = ends + np.cumsum(np.bincount(rows, minlength=len(lower)))
        _, places, data = pa.array(known, pa.binary()).take(pa.array(numbers)).buffers()
        starts = np.frombuffer(places, np.int32)[np.concatenate([[0], last])]
        return pa.Array.from_buffers(pa.binary(), len(lower), [None, pa.py_buffer(starts), data])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
