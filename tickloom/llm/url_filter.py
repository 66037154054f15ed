"""URL filters: pattern rules indexed by their rarest literal token.

A URL is its host and path. Each rule is a regular expression over host + path with the
literal tokens (runs of letters and digits) that whatever it fits must hold. Tokens are
counted over all URLs, and a rule is indexed under its rarest one. A URL's tokens fetch
candidate rules by an equi-join, and only those run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: A set of rules up to this many is small enough to send to every executor (some 100 bytes each).
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """name: what the result shows; rank: 1 for site rules, which go before pattern rules (0)."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains, and paths that start with path."""
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower() if path.isascii() else "")
    quote = lambda x: r"\Q" + x + r"\E" if x else ""
    return Rule(host + path, verdict, r"^(?:[^/]*\.)?" + quote(host) + r"(?![^/])" + quote(path), tuple(tokens), 1)


def word_rule(word: str) -> Rule:
    """Blocks URLs that have the word between other characters than letters and digits."""
    return Rule(f"*{word}*", "block", rf"(?<![A-Za-z0-9])(?i:{word})(?![A-Za-z0-9])", (word,))


def ending_rule(ending: str) -> Rule:
    """Blocks URLs whose path ends with a dot and the ending."""
    return Rule(f"*.{ending}", "block", rf"^[^/]*/.*\.(?i:{ending})$", (ending,))


#: Words in the host or path of sites that training data should not have.
BLOCK_WORDS = (
    "adult", "bets", "betting", "casino", "escort", "escorts", "gambling", "hentai", "jackpot", "nude", "nudes", "phentermine", "pills",
    "poker", "porn", "porno", "roulette", "sexcam", "slots", "spam", "sportsbook", "viagra", "warez", "webcams", "xxx",
)
#: Endings of files that hold no text.
BLOCK_ENDINGS = ("apk", "avi", "dmg", "exe", "gif", "iso", "jpeg", "jpg", "mkv", "mp3", "mp4", "msi", "png", "rar", "tgz", "zip")
DEFAULT_RULES = (*(word_rule(w) for w in BLOCK_WORDS), *(ending_rule(e) for e in BLOCK_ENDINGS))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(address: Column) -> Column:
    low = F.translate(address, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.split(F.concat(F.lit("/"), low), "[^a-z0-9]+"))  # an empty token always leads


def filter_urls(pages: DataFrame, rules: list[Rule] | tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict.

    Of the fitting rules the one of the highest rank wins, then the one of the longest name, then
    block. rule is its name (null for pattern rules and where none fits); verdict is allow where
    none fits. Null URLs, and those without "://", have an empty host and path and are judged
    like any other. Older columns of these names give way.
    """
    spark = pages.sparkSession
    new = {"host", "path", "rule", "verdict"} - {url_col.lower()}
    pages = pages.drop(*[c for c in pages.columns if c.lower() in new])
    # judged once for each distinct host and path
    host, path, best_col = unused(pages, "host", "path", "best")
    kept = [F.col(f"`{c}`") for c in pages.columns]
    address = F.concat(host, path)
    pages = pages.withColumns({host: url_host(F.col(f"`{url_col}`")), path: url_path(F.col(f"`{url_col}`"))})
    tokens = pages.select(host, path).distinct().select(host, path, F.explode(_tokens(address)).alias("token"))
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, sorted({*r.tokens}) or [""], r.rank) for i, r in enumerate(rules)],
        "rule_id int, name string, verdict string, pattern string, tokens array<string>, rank int",
    )
    literal = table.select("rule_id", F.explode("tokens").alias("token"))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    counts = tokens.join(small(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(counts, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = table.drop("tokens").join(rarest, "rule_id")
    fits = tokens.join(small(index), "token").where(F.regexp_like(address, F.col("pattern")))
    best = fits.groupBy(host, path).agg(F.max(F.struct("rank", F.length("name").alias("length"), "verdict", "name")).alias(best_col))
    added = {"host": F.col(host), "path": F.col(path), "rule": F.when(F.col(f"{best_col}.rank") == 1, F.col(f"{best_col}.name")), "verdict": F.coalesce(f"{best_col}.verdict", F.lit("allow"))}
    return pages.join(best, [host, path], "left").select(*kept, *[c.alias(name) for name, c in added.items() if name in new])
