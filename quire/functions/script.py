"""Writing system and direction of texts, by counts of code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In order of priority on ties; latin, which also takes all other letters, comes last.
SCRIPTS = (("arabic", "IsArabic"), ("hebrew", "IsHebrew"), ("devanagari", "IsDevanagari"), ("cjk", "IsHan"), ("thai", "IsThai"), ("korean", "IsHangul"), ("cyrillic", "IsCyrillic"))
RIGHT_TO_LEFT = r"\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}"
#: All of these scripts' characters lie here, which is a quicker test than their names are.
BEYOND = r"[\x{370}-\x{10FFFF}]"
#: Full-width scripts take a whole em for each character, others half of one.
FULL_WIDTH = ("cjk", "korean")


def is_rtl(s: Column) -> Column:
    """More right-to-left characters than other letters."""
    text = F.coalesce(s, F.lit(""))
    other = F.regexp_replace(text, f"[{RIGHT_TO_LEFT}]+", "")
    more = F.regexp_count(text, F.lit(f"[{RIGHT_TO_LEFT}]")) > F.regexp_count(other, F.lit(r"\p{L}"))
    return F.when(text.rlike(BEYOND), more).otherwise(F.lit(False))


def detect_script(s: Column) -> Column:
    """The script with most characters; the earlier of two that tie; latin where there is none."""
    text = F.coalesce(s, F.lit(""))
    named = "".join(rf"\p{{{name}}}" for _, name in SCRIPTS)
    counts = [F.struct(F.regexp_count(text, F.lit(rf"\p{{{name}}}")).alias("n"), F.lit(-i).alias("p"), F.lit(script).alias("s")) for i, (script, name) in enumerate(SCRIPTS)]
    rest = F.regexp_count(F.regexp_replace(text, f"[{named}]+", ""), F.lit(r"\p{L}"))
    counts.append(F.struct(rest.alias("n"), F.lit(-len(SCRIPTS)).alias("p"), F.lit("latin").alias("s")))
    best = F.array_max(F.array(*counts))
    # most texts hold nothing but Latin letters: one scan tells
    return F.when(text.rlike(BEYOND), F.when(best["n"] > 0, best["s"]).otherwise("latin")).otherwise("latin")


def char_ratio(s: Column) -> Column:
    """Mean width of a character in units of the font size."""
    return F.when(detect_script(s).isin(*FULL_WIDTH), F.lit(1.0)).otherwise(F.lit(0.5))
