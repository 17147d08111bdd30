"""Fitting text into boxes: greedy wrapping and a search over font sizes, all inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import bound, chunks
from quire.functions.script import char_ratio
from quire.functions.text import collapse

LINE_HEIGHT, SMALLEST, EXPANSION, STEP, DEFAULT_SIZE = 1.35, 0.6, 1.5, 0.5, 12.0


def per_line(width: Column, size: Column, ratio: Column) -> Column:
    """Characters that a line holds, 1 at least."""
    char = F.when(size * ratio <= 0, F.lit(6.0)).otherwise(size * ratio)
    return F.greatest(F.lit(1), (width / char).cast("int"))


def wrap_words(words: Column, limit: Column) -> Column:
    """Greedy lines of at most `limit` characters; longer words stand alone; no words give one empty line.

    Words are folded a chunk at a time; only the line begun is carried on, and a chunk's lines
    are set aside as one element. So finished lines aren't copied for each word.
    """
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.expr("cast(array() as array<array<string>>)").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(w) <= limit
        done = F.when(s["line"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["line"])))
        line = F.when(s["line"].isNull(), w).when(fits, F.concat_ws(" ", s["line"], w)).otherwise(w)
        return F.struct(done.alias("done"), line.alias("line"))

    def some(s: Column, chunk: Column) -> Column:
        folded = F.aggregate(chunk, F.struct(none.alias("done"), s["line"].alias("line")), step)
        return bound(folded, lambda f: F.struct(F.concat(s["done"], F.array(f["done"])).alias("done"), f["line"].alias("line")))

    whole = lambda s: F.concat(F.flatten(s["done"]), F.array(F.coalesce(s["line"], F.lit(""))))
    return F.aggregate(bound(words, chunks), start, some, whole)


#: Beyond these a character may be of two units in a regular expression's eyes, whose repetitions then nest.
PAIRS = r"[\x{10000}-\x{10FFFF}]"


def _line(limit: Column) -> Column:
    """A pattern whose matches in words joined by blanks are the greedy lines of at most `limit` characters; group 1 has no blank behind."""
    return F.concat(F.lit("(?s)(.{1,"), limit.cast("string"), F.lit(r"}|[^ ]+)(?: |\z)"))


def wrap_joined(joined: Column, limit: Column) -> Column:
    """wrap_words of words joined by single blanks: one scan by a regular expression instead of a step for each word."""
    scanned = F.regexp_extract_all(joined, _line(limit), F.lit(1))
    lines = F.when(joined == "", F.array(F.lit(""))).otherwise(scanned)
    return F.when(joined.rlike(PAIRS), wrap_words(F.array_remove(F.split(joined, " "), ""), limit)).otherwise(lines)


def wrap_text(text: Column, width: Column, size: Column, ratio: Column) -> Column:
    """Lines of a text without hard breaks."""
    return bound(collapse(F.coalesce(text, F.lit(""))), lambda t: wrap_joined(t, per_line(width, size, ratio)))


def count_lines(joined: Column, limit: Column) -> Column:
    """How many lines wrap_joined would give: characters beyond the basic plane count as any others."""
    return F.greatest(F.regexp_count(F.regexp_replace(joined, PAIRS, "x"), _line(limit)), F.lit(1))


def fit_text(text: Column, width: Column, height: Column, size: Column) -> Column:
    """struct(lines, font_size, line_height, box_height, overflow) of a text in a box.

    The first of these that holds: the lines fit at the given size; at a size smaller by halves
    of a point, down to the first below 60 %; at 60 % in a box half as high again; else the
    lines beyond that box are cut and the last one kept ends in an ellipsis. Sizes are tried by
    counting lines; the lines themselves are made once.
    """
    s0 = F.when(size > 0, size).otherwise(F.lit(DEFAULT_SIZE))
    box = F.struct(collapse(F.coalesce(text, F.lit(""))).alias("t"), char_ratio(text).alias("ratio"), width.cast("double").alias("w"), height.cast("double").alias("h"), s0.alias("s0"))

    def chosen(b: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(0), (b["s0"] * 0.8).cast("int") + 2), lambda k: (k == 0) | (b["s0"] - STEP * (k - 1) >= b["s0"] * SMALLEST))
        total = F.length(b["t"]) + 1

        def fits(s: Column) -> Column:
            """Whether the lines are low enough, by bounds on their number where these tell, else by counting them.

            Of two lines that follow each other both together have more than n + 1 characters
            with their blanks, and what has no more is one line.
            """

            def within(n: Column) -> Column:
                low = lambda lines: s * LINE_HEIGHT * lines <= b["h"]
                most = F.when(total <= n + 1, F.lit(1)).otherwise(F.floor(2 * total / (n + 1)) + 1)
                return F.when(~low(F.lit(1)), F.lit(False)).when(low(most), F.lit(True)).when(total <= n + 1, F.lit(False)).otherwise(low(count_lines(b["t"], n)))

            return bound(per_line(b["w"], s, b["ratio"]), within)

        # once a size has fitted, the rest are passed over
        first = F.aggregate(steps, F.lit(None).cast("double"), lambda got, k: F.coalesce(got, F.when(fits(b["s0"] - STEP * k), b["s0"] - STEP * k)))
        return F.struct(b.alias("b"), first.alias("first"))

    def made(c: Column) -> Column:
        b = c["b"]
        s = F.coalesce(c["first"], b["s0"] * SMALLEST)
        lines = bound(per_line(b["w"], s, b["ratio"]), lambda n: wrap_joined(b["t"], n))
        return F.struct(lines.alias("lines"), s.alias("font_size"), (s * LINE_HEIGHT).alias("line_height"), b["h"].alias("h"), c["first"].isNotNull().alias("fits"))

    return bound(bound(bound(box, chosen), made), _boxed)


def _boxed(c: Column) -> Column:
    high, room = c["line_height"] * F.size(c["lines"]), c["h"] * EXPANSION
    most = F.greatest(F.lit(1), (room / c["line_height"]).cast("int"))
    last = F.element_at(c["lines"], most)
    cut = F.when(F.length(last) > 3, F.concat(F.substring(last, F.lit(1), F.length(last) - 3), F.lit("..."))).otherwise(last)
    kept = F.when(F.size(c["lines"]) > most, F.concat(F.slice(c["lines"], F.lit(1), most - 1), F.array(cut))).otherwise(c["lines"])
    whole = c["fits"] | (high <= room)
    return F.struct(
        F.when(whole, c["lines"]).otherwise(kept).alias("lines"),
        c["font_size"].alias("font_size"),
        c["line_height"].alias("line_height"),
        F.when(c["fits"], c["h"]).when(high <= room, high).otherwise(room).alias("box_height"),
        (~c["fits"]).alias("overflow"),
    )


def text_width(text: Column, size: Column) -> Column:
    """Estimated width of a text."""
    return F.length(text) * size * char_ratio(text)
