"""URL verdicts: rules by longest match, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import column, read, replaced, shipped
from quire.llm.labelled import ALLOW, BLOCK

#: Fixed values: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Common words of sites by topic, written down from general knowledge, of which the larger part of the labelled table is made.
BLOCKED = {
    "gambling": ("casino", "poker", "roulette", "betting", "jackpot", "slots", "bingo", "lottery", "gambler", "blackjack"),
    "pills": ("viagra", "pills", "pharma", "steroids", "cialis", "weightloss", "tablets", "nopresc", "dietpill", "bodyhack"),
    "adult": ("porn", "sexcam", "xxx", "escorts", "nude", "hotgirls", "hookup", "adults", "webcams", "playmate"),
    "scams": ("payday", "getrich", "winner", "prizes", "giveaway", "fastcash", "cheap", "loans", "replica", "freebie"),
    "piracy": ("warez", "torrents", "cracked", "keygen", "serialz", "nulled", "pirated", "streamz", "modapk", "hacked"),
    "adverts": ("spammer", "adserver", "popunder", "clickbait", "banners", "affiliate", "tracking", "traffic", "leadgen", "adclicks"),
}
WELCOME = {
    "study": ("library", "museum", "school", "college", "archive", "history", "science", "physics", "lecture", "biology"),
    "home": ("garden", "kitchen", "recipes", "baking", "knitting", "family", "pottery", "flowers", "carpentry", "birdwatch"),
    "news": ("gazette", "journal", "weather", "herald", "tribune", "review", "magazine", "reporter", "bulletin", "chronicle"),
    "town": ("cityhall", "council", "railway", "hospital", "parish", "harbour", "theatre", "orchestra", "firebrigade", "village"),
    "craft": ("software", "compiler", "database", "manual", "opensource", "robotics", "networks", "mathematics", "hardware", "graphics"),
    "sport": ("cycling", "rowing", "football", "climbing", "athletics", "hiking", "sailing", "swimming", "marathon", "chess"),
}
TOPS = ("com", "org", "net", "info", "eu", "co.uk", "de", "fr", "es", "io", "co")
PLAIN_PATHS = ("", "/", "/index.html", "/2021/05/article", "/about", "/p?id=3", "/news/today", "/docs/guide", "/archive", "/7", "/en/", "/a/b/c")
#: Made urls of each topic, and as many invented names as fill the welcome ones up; copies of each
#: url that is written out, which make these weigh about as much.
PER_TOPIC, INVENTED, COPIES = 60, 240, 4
THRESHOLD = 0.65


BUCKETS = 1 << 15
SIZES = (3, 4, 5)


def invented(rnd: random.Random) -> str:
    """A pronounceable name without meaning."""
    return "".join(rnd.choice("bcdfghjklmnprstvwz") + rnd.choice(("a", "e", "i", "o", "u", "ai", "on", "er", "an", "is")) for _ in range(rnd.randint(2, 4)))


def labelled_urls(keep: Callable[[str], bool] = lambda word: True, seed: int = 3) -> list[tuple[str, int]]:
    """The small labelled table, 1 for blocked: the urls of labelled.py, written out, and more made by rule from the word lists.

    A made host joins two words of a topic, or a word and an invented name; half of the blocked
    topics' urls have a word in their path, too. Invented hosts are allowed: a name says nothing
    by itself. `keep` leaves out words and written urls (to hold some out).
    """
    rnd, rows = random.Random(seed), []
    rows += [(u, label) for urls, label in ((BLOCK, 1), (ALLOW, 0)) for u in urls if keep(u)] * COPIES
    front = lambda: rnd.choice(("", "", "", "www.", "www.", "m."))
    for topics, label in ((BLOCKED, 1), (WELCOME, 0)):
        for words in topics.values():
            words = [w for w in words if keep(w)]
            for _ in range(PER_TOPIC if len(words) > 1 else 0):
                a, b = rnd.sample(words, 2)
                name = a + rnd.choice(("-", "", "-")) + (b if rnd.random() < 0.5 else invented(rnd))
                path = f"/{rnd.choice(words)}/{rnd.randint(1, 99)}" if label and rnd.random() < 0.5 else rnd.choice(PLAIN_PATHS)
                rows.append((f"https://{front()}{name}.{rnd.choice(TOPS)}{path}", label))
    rows += [(f"https://{front()}{invented(rnd)}{rnd.choice(('', '-' + invented(rnd)))}.{rnd.choice(TOPS)}{rnd.choice(PLAIN_PATHS)}", 0) for _ in range(INVENTED)]
    return rows


def parts(url: str) -> tuple[str, str]:
    """Host and path as the query's columns give them."""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[:stop]


def grams(host: str, path: str) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a host and of a path, each marked with its side."""
    found = set()
    for side, s in ((0, f"^{host}$"), (1, f"^{path}$")):
        raw = s.encode("utf-8", "surrogatepass")
        for n in SIZES:
            found.update(zlib.crc32(raw[i : i + n], side) % BUCKETS for i in range(len(raw) - n + 1))
    return np.array(sorted(found), np.int64)


def train(rows: Sequence[tuple[str, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of the buckets, then the bias, by gradient descent with adaptive steps. Deterministic."""
    xs = [grams(*parts(u)) for u, _ in rows]
    y = np.array([v for _, v in rows], float)
    at, owner = np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    scale = np.array([1 / math.sqrt(max(1, len(x))) for x in xs])
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    balance = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    for _ in range(steps):
        z = np.bincount(owner, w[at], len(xs)) * scale + w[-1]
        d = (1 / (1 + np.exp(-z)) - y) * balance / len(y)
        g = np.bincount(at, (d * scale)[owner], BUCKETS + 1)
        g[-1] = d.sum()
        g[:-1] += decay * w[:-1] / len(y)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


@lru_cache(maxsize=1)
def default_weights() -> np.ndarray:
    return train(labelled_urls())


def probability(w: np.ndarray, host: str, path: str) -> float:
    x = grams(host, path)
    return float(1 / (1 + np.exp(-(w[x].sum() / math.sqrt(max(1, len(x))) + w[-1]))))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    best = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        best, verdict = F.when(fits, rule).otherwise(best), F.when(fits, says).otherwise(verdict)
    return best, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, block_score and verdict to rows with a `url`.

    A rule (host, then path prefix) fits its host and every subdomain where the url's path starts
    with its path; the longest decides. All other urls are blocked where the classifier,
    trained here from the small labelled table, scores `threshold` or more. Null urls and those
    without :// have an empty host and path and are scored as such. Rows are judged alone, no
    shuffle; only the url goes to Python. Columns named like an added one are replaced.
    """
    shipped(pages.sparkSession)
    w = train(labelled) if labelled is not None else default_weights()

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([probability(w, h.as_py() or "", p.as_py() or "") for h, p in zip(hosts, paths)], pa.float64())

    pages = replaced(pages, "host", "path", "rule", "block_score", "verdict")
    out = pages.withColumn("_url", F.coalesce(column(pages, "url", "string"), F.lit("")))
    out = out.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}).drop("_url")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "block_score": score("host", "path")})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each url of `pages`; null urls and those without :// are scored as empty ones, repeats alike."""
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")
