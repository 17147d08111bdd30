"""Line-first cleaning, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ALL, column, n_words, read, replaced, word_chars, words

SYMBOLS = "#*$%&|<>"
#: Sentences of page furniture in the four languages of the corpus; they fail a line of at most
#: BOILERPLATE_WORDS words. Dots stand for accented letters.
BOILERPLATE = (
    r"(?i)cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|sign up for our|subscribe to our|click here|skip to content|lorem ipsum|back to top"
    r"|cookie-richtlinie|datenschutzerkl.rung|nutzungsbedingungen|alle rechte vorbehalten|newsletter abonnieren|hier klicken|zum inhalt springen|nach oben scrollen"
    r"|politique de confidentialit.|conditions d.utilisation|tous droits r.serv.s|abonnez-vous|cliquez ici|aller au contenu|haut de page"
    r"|pol.tica de (?:cookies|privacidad)|t.rminos y condiciones|todos los derechos reservados|suscr.bete|haga? clic aqu.|saltar al contenido|volver arriba"
)
BOILERPLATE_WORDS = 15


def line_fails(line: Column) -> Column:
    """Whether a line is punctuation noise, navigation or boilerplate. Lines without words never fail.

    punctuation: symbols make up a tenth of its visible characters, or a third of its words are
    shouted (end in "!!"), or it has eight or more words of which none has a letter.
    navigation: two or more separators (|, », ›, •) and at least one for every six words.
    boilerplate: a short line holding a furniture phrase.
    """
    # cheap tests stand first: the others are only made where those hold
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    visible = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    noisy = (symbols > 0) & (symbols * 10 >= visible)
    shouted = line.contains("!!") & (F.regexp_count(line, F.lit(r"!!+(?=[\x20\x09-\x0D]|$)")) * 3 >= n)
    wordless = ~line.rlike(r"\p{L}") & (n >= 8)
    menu = (bars >= 2) & (bars * 6 >= n)
    furniture = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return line.rlike(r"[^\x20\x09-\x0D]") & (noisy | shouted | wordless | menu | furniture)


def windows(w: Column) -> Column:
    """A 64-bit hash of each 3-word window of an array of words, in order."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    return F.transform(F.slice(w, 1, n), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))


def _covered(windows: Column) -> Column:
    """From the windows' hashes the number of words that lie in windows found twice or more, first places included.

    The hashes are sorted with their places; neighbours that agree give their places, and each
    place covers itself and the next two.
    """

    def neighbours(s: Column) -> Column:
        return F.filter(F.zip_with(s, F.slice(s, 2, ALL), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())

    def spans(p: Column) -> Column:
        return F.aggregate(F.zip_with(p, F.slice(p, 2, ALL), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)

    # transform over a one-element array binds a value once, where a plain reference would be computed for each use
    tagged = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    places = F.transform(F.array(F.sort_array(tagged)), lambda s: F.sort_array(F.array_distinct(F.flatten(neighbours(s)))))
    found = F.element_at(F.transform(places, spans), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found).cast("long")


def quality(docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, max_removed: float = 0.3) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, removed_chars, kept.

    `cleaned` is the text without its failed lines. Documents that lose more than max_removed of
    their visible characters that way are rejected, as are those with under min_words words or
    with more than max_repeat of their words in repeated windows. Null and empty texts have
    counts of 0 and are rejected as too short. Each row is judged alone: no shuffle, and copies
    and ties are alike. Input columns named like an added one are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "removed_chars", "kept")
    docs = replaced(docs, *added)
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(text), "_lines": worded})
    out = out.withColumns({"_win": windows(F.col("_w")), "n_words": F.size("_w").cast("long")})
    out = out.withColumns(
        {
            "word_chars": word_chars(text),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("_win")),
            "cleaned": F.array_join(F.filter(F.split(text, "\n", -1), lambda l: ~line_fails(l)), "\n"),
        }
    )
    # most texts lose nothing
    left = F.when(F.length("cleaned") == F.length(text), F.col("word_chars")).otherwise(word_chars(F.col("cleaned")))
    out = out.withColumn("removed_chars", F.col("word_chars") - left)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= F.lit(float(max_removed)) * F.col("word_chars")))
    return out.drop("_w", "_lines", "_win")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of whole `documents`; null and empty texts fail as too short, repeated rows are judged alike."""
    return quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "kept")


#: DuckDB's form of line_fails, for a column named line.
FAILS_SQL = r"""
(visible > 0 and ((symbols * 10 >= visible and symbols > 0)
  or (contains(line, '!!') and len(regexp_extract_all(line || ' ', '!!+[\x20\x09-\x0D]')) * 3 >= n)
  or (n >= 8 and not regexp_matches(line, '\p{L}'))
  or (bars >= 2 and bars * 6 >= n)
  or (regexp_matches(line, '""" + BOILERPLATE + r"""') and n <= 15)))
"""
LINES_SQL = r"""
lines as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d),
measured as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as visible,
    length(line) - length(translate(line, '#*$%&|<>', '')) as symbols,
    length(line) - length(translate(line, '|»›•', '')) as bars from lines),
judged as (select rid, k, line, n, visible, """ + FAILS_SQL + r""" as fails from measured)
"""
#: Common table expressions up to `verdict` (a row per document with everything that quality() adds).
CTES_SQL = r"""
d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents), """ + LINES_SQL + r""",
by_doc as (select rid, coalesce(sum(visible), 0)::bigint as word_chars, coalesce(sum(n), 0)::bigint as n_words,
    (count(*) filter (n > 0) - count(distinct line) filter (n > 0))::bigint as n_dup_lines,
    coalesce(sum(visible) filter (fails), 0)::bigint as removed_chars,
    coalesce(string_agg(line, chr(10) order by k) filter (not fails), '') as cleaned from judged group by rid),
ws as (select rid, unnest(w) as w, generate_subscripts(w, 1) as i from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d)),
win as (select rid, i, w as a, lead(w) over o as b, lead(w, 2) over o as c from ws window o as (partition by rid order by i)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from win where c is not null) where n > 1),
rep as (select rid, count(distinct p)::bigint as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from dup) group by rid),
counted as (select d.*, word_chars, n_words, n_dup_lines, removed_chars, cleaned, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::bigint as n_symbols
  from d join by_doc using (rid) left join rep using (rid)),
verdict as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_chars <= 0.3::double * word_chars as kept from counted)
"""
SQL = "with " + CTES_SQL + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, kept from verdict"
