"""Text cleaning as column expressions; order as in ``cleaned``: unicode, tags, line ends, white space, noise lines, paragraphs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that match one of these anywhere are noise.
NOISE_PATTERNS = (
    r"^\s*$",
    r"^[\s\-–—*=+_~#°•·‣⁃◦●○◆◇▪▫■□▸▹►▻▼▽]+$",
    r"(?i)^copyright|©|all rights reserved",
    r"(?i)^privacy policy|terms of service|免责声明|隐私政策|cookie",
    r"(?i)^(share|tweet|pin|like|follow)\s",
    r"(?i)^(advertisement|sponsored|推广|广告)",
    r"(?i)^(page\s*\d+|第\s*\d+\s*页)$",
    r"^<!--.*-->$",
    r"(?i)^<[/!]?(div|span|a|p|li|ul|ol|section|article|header|main|script|style|button|input)[^>]*>.*$",
    r"(?i)^<[/!]?[a-zA-Z][a-zA-Z0-9-]*[^>]*>\s*$",
    r"(?i)^(Earn XP|Streaks|Leagues|Your Own Space|See More|Search field|Sign In|user-anonymous)\b",
    r"(?i)^\[(\*\*|★|\+1|×)\]",
    r"(?i)^(Menu|Home|Tutorials|References|Exercises|Certificates|Bootcamps|Services)\s*$",
    r"(?i)^\s*(original:|ny:|MainLeaderboard|Leaderboard|start\s*$)",
    r"(?i)^\[(❮|❯|Previous|Next)[^\]]*\]\(",
    r"(?i)^\[(Sign in|Log in|Create a free|Start learning|Track your progress|Go to)\b[^\]]*\]\(",
    r"(?i)^\s*<[a-zA-Z]+[^>]*class=['\"]w3-[^'\"]*['\"][^>]*>",
    r"^\s*</?[a-zA-Z]+[^>]*\s*>?\s*$",
    r"(?i)^(\[\*\*$|\[★$|\+1\]\(|Copy link\.|Shares the page URL)",
    r"(?i)^/\s*(LinkedIn|Twitter|Facebook|Copy link)\b",
    r"(?i)^(❮|❯|Previous|Next|previous|next)\s*(❮|❯|Previous|Next|previous|next|\||$)",
    r"(?i)^(ADVERTISEMENT|AD\b|\[advertisement\])",
    r"(?i)^(Track your progress|Log in|Sign up|Create a free|Report Error|Report error|Try it Yourself)",
    r"(?i)^(Contact|Contact Sales|Sales|Send us an e-mail)",
    r"(?i)^(Video:|Video Course|Course Navigation|Video Course Navigation)",
    r"(?i)^(Exercise\??|Exercises|Test Yourself|Quiz|QUIZ)\s*\??\s*$",
    r"(?i)^(Reset Score|Reset score|Close This Menu|Close this menu|Hide Ads|Hide ads)",
    r"(?i)^.+?(Log in|Sign Up|signup|login)\s*(now|today|to|for|free)",
    r"(?i)^(W3Schools|w3schools)\s+(is|offers|provides|Home|Tutorials|References|Exercises)",
    r"(?i)^(The W3Schools online code editor|With our online)",
    r"(?i)^(Home|Back to|Return to|Go to)\s+(top|home|previous|next|tutorial|menu|page)",
    r"(?i)^(Main Navigation|Site Navigation|Breadcrumb|breadcrumb)",
    r"(?i)^(Last (updated|modified)|Published|Posted)\s*(on|:)",
    r"(?i)^Tags?:\s*[#\w\-,][#\w\-,\s]*$",  # repeats of runs said as one run, which can't backtrack
    r"^#+\s*$",
    r"(?i)^#{1,6}\s*(Example|Examples?|Note|Notes?|Tip|Tips?|Warning|See Also|See also)\s*:?\s*$",
    r"(?i)^#{1,6}\s*(Demo|Try it|Exercise|Practice|Test|Challenge|Task)\s*:?\s*$",
)
#: One pattern for all, each with its own flags.
NOISE = "|".join(f"(?:{p})" for p in NOISE_PATTERNS)
TAG = r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s+[^<>]*?)?\s*/?>"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def _composed(text: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(nfc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))  # plain texts don't travel


def sanitized(text: Column) -> Column:
    """No-break spaces to spaces, no control or format characters but tab and line ends, full-width ASCII narrow, composed."""
    spaced = F.translate(text, "  ", "  ")
    return _composed(F.translate(F.regexp_replace(spaced, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", ""), _WIDE, _NARROW))


def without_tags(text: Column) -> Column:
    """Left-over tags of web imports go, with the spaces around line ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAG, ""), " +\n", "\n"), "\n +", "\n")


def trimmed_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def normal_space(text: Column) -> Column:
    """Line feeds only, at most one blank line at a time, no white space around."""
    fed = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(fed, r"(?U)^\s+|\s+$", "")


def without_noise(text: Column) -> Column:
    """Lines that match a noise pattern are dropped, blank ones too."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(NOISE)), "\n")


def distinct_paragraphs(text: Column) -> Column:
    """A paragraph equal to the one kept before it, but for case and white space around, is dropped; blank ones stay."""
    bare = lambda p: F.lower(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    before = lambda parts, i: F.get(parts, i - 1)
    kept = lambda parts: F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (bare(p) == "") | (bare(p) != bare(before(parts, i))), p)), lambda p: p.isNotNull())
    return F.array_join(_once(F.split(text, "\n\n", -1), kept), "\n\n")


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cleaned(text: Column, web: Column) -> Column:
    """The whole chain; ``web`` tells which texts may hold tags."""
    first = sanitized(text)
    plain = F.when(web, without_tags(first)).otherwise(first)
    return distinct_paragraphs(without_noise(normal_space(trimmed_lines(plain))))


def token_estimate(text: Column) -> Column:
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def model_tokens(text: Column) -> Column:
    """An estimate that may be 0, as models are billed."""
    return F.floor(F.length(text) / 4).cast("int")


def titled(title: Column, content: Column) -> Column:
    """What is embedded of a chunk: its title and content; without title the content alone."""
    return F.when(F.trim(title) != "", F.concat(title, F.lit(" —— "), content)).otherwise(content)


def front_matter(title: Column, topic: Column, default_version: str = "3.13") -> Column:
    """A header for a page: title, topic, and the version that the title names."""
    version = F.coalesce(F.nullif(F.regexp_extract(title, r"\d+\.\d+", 0), F.lit("")), F.lit(default_version))
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ntopic: "), F.coalesce(topic, F.lit("")), F.lit("\nversion: "), version, F.lit("\n---\n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def preview(text: Column, signs: int = 200) -> Column:
    return F.substring(text, 1, signs)
