"""One form for texts that look the same but differ in their characters.

Whether a character can be part of a change is a property of the character (its quick check): it has another canonical form,
or it can join the character before it. Segments of such characters, with the one stable character before them as context,
are normalized; everything between them is kept as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecast.functions.keys import key
from lorecast.operators.skew import HOT_ROWS, salted_join
from lorecast.session import write_shared

# Letters of other scripts (and two of Latin) and the Latin letter each looks like, by script.
LOOK_ALIKES_OF = {
    "Cyrillic": {
        "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
        "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
    },
    "Greek": {
        "ϲ": "c", "ι": "i", "ϳ": "j", "ο": "o", "ρ": "p", "υ": "u", "ν": "v",
        "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    },
    "Armenian": {"ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U"},
    "Cherokee": {
        "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    },
    "Coptic": {"ⲥ": "c", "ⲟ": "o", "ⲣ": "p", "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y"},
    "Lisu": {
        "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    },
    "Latin": {"ɑ": "a", "ɡ": "g", "ꞌ": "'"},
}
LOOK_ALIKES = {sign: latin for signs in LOOK_ALIKES_OF.values() for sign, latin in signs.items()}
# Where the letters of these scripts stand, as insides of character classes.
BLOCKS = {"Cyrillic": "Ѐ-ԯ", "Greek": "Ͱ-Ͽἀ-῿", "Armenian": "԰-֏", "Cherokee": "Ꭰ-᏿", "Coptic": "Ⲁ-⳿", "Lisu": "ꓐ-꓿"}

# Ranges of characters that show nothing.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF), (0x0000, 0x0008), (0x000D, 0x000F), (0x0010, 0x001B), (0x007F, 0x0084),
    (0x0086, 0x009F),
)

# Blocks whose compatibility forms look like what they stand for: joined letters, Roman numerals, radicals.
SAME_LOOK = ((0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


def _within(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def spans(points: set[int]) -> str:
    """The inside of a character class of these code points."""
    runs: list[list[int]] = []
    for cp in sorted(points):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def properties() -> tuple[dict[int, str], set[int]]:
    """What each character becomes, and those that need a look (the quick check says no or maybe)."""
    table: dict[int, str] = {ord(a): b for a, b in LOOK_ALIKES.items()}
    joins: set[int] = set()
    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000:
            continue
        if _within(cp, INVISIBLE):
            table[cp] = ""
            continue
        ch = chr(cp)
        form = unicodedata.decomposition(ch)
        if form:
            kind = form.split()[0]
            if kind in ("<wide>", "<narrow>") or kind == "<compat>" and _within(cp, SAME_LOOK):
                table[cp] = unicodedata.normalize("NFKC", ch)
            elif kind[0] != "<" and " " in form:
                joins.update(int(x, 16) for x in form.split()[1:])
        if unicodedata.category(ch) == "Zs" and cp != 32:
            table[cp] = " "
    for cp, to in list(table.items()):  # a wide form may itself have a canonical form
        table[cp] = unicodedata.normalize("NFD", to).translate(table) if to not in ("", " ") else to
    marks = {cp for cp in range(0x300, 0x20000) if unicodedata.combining(chr(cp))}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    letters = {cp for cp in range(0x80, 0x30000) if not 0xAC00 <= cp <= 0xD7A3 and (n := unicodedata.normalize("NFD", chr(cp))) != chr(cp) and unicodedata.normalize("NFC", n.translate(table)) != chr(cp)}
    return table, set(table) | marks | jamo | letters | joins - set(range(128))


class Canonicalizer:
    """``text`` to its canonical form: signs that stand for one other sign are replaced, then the segments of what is left that
    can change or join are normalized with the stable sign before them, and spliced into the rest."""

    def __init__(self):
        self.table, unstable = properties()
        single = {c for c in unstable if len(self.table.get(c, "")) == 1 and c < 0x10000}
        self.single = re.compile(f"[{spans(single)}]")
        self.moving = re.compile(f"[{spans({c for c in unstable - single if c < 0x10000})}]+")
        self.anywhere = re.compile(f"[{spans(unstable - single)}]+")  # slower, for texts with signs beyond the basic plane
        self.backs = {n: {ord(b): a for a, b in reversed(LOOK_ALIKES_OF[n].items())} for n in BLOCKS}
        self.own = {n: re.compile(f"[{block}]") for n, block in BLOCKS.items()}
        self.foreign = re.compile(f"[{''.join(BLOCKS.values())}]")

    def normal(self, segment: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment).translate(self.table))

    def replaced(self, text: str) -> tuple[str, re.Pattern]:
        """``text`` with single signs replaced, and the pattern of the segments to look at."""
        table = self.table
        return self.single.sub(lambda m: table[ord(m[0])], text), self.anywhere if _ASTRAL.search(text) else self.moving

    def _genuine(self, word: re.Match) -> str:
        """A word with letters of one other script that look like no Latin ones is of that script: its look-alikes become its own."""
        bare = unicodedata.normalize("NFD", word[0])
        of = [n for n, own in self.own.items() if own.search(bare)]
        return unicodedata.normalize("NFC", bare.translate(self.backs[of[0]])) if len(of) == 1 else word[0]

    def __call__(self, text: str) -> str:
        """The one form: that of looks, with words of other scripts in their own letters. Equal looks give equal forms."""
        text = self.look(text)
        return _WORD.sub(self._genuine, text) if not text.isascii() and self.foreign.search(text) else text

    def look(self, text: str) -> str:
        """The form in which all letters that look like Latin ones are."""
        if text.isascii() and not _CONTROL.search(text):
            return text
        text, segments = self.replaced(text)
        out, last = [], 0
        for m in segments.finditer(text):
            i = max(last, m.start() - 1)
            out += [text[last:i], self.normal(text[i : m.end()])]
            last = m.end()
        return "".join(out) + text[last:] if out else text


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_CONTROL = re.compile(r"[\x00-\x08\x0d-\x1b\x7f]")


@lru_cache(1)
def canonicalizer() -> Canonicalizer:
    """Made once on the driver and carried to the tasks."""
    return Canonicalizer()


def canonical(text: Column) -> Column:
    """The one form of ``text``; null stays null, an empty text empty, however long it is.

    Width forms, composed and combined accents, kinds of blank, invisible characters, joined letters and look-alike letters
    come out alike; words of another script keep its letters. Case, accents, line breaks and signs drawn differently stay apart;
    a carriage return shows nothing.
    """
    canon = canonicalizer()

    @F.pandas_udf("string")
    def changed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                c = None if t is None else canon(t)
                out.append(None if c == t else c)  # what is stable doesn't travel back
            yield pd.Series(out, dtype=object)

    return F.coalesce(changed(text), text)


def look_alikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, text_hash): each distinct id and text with the hash of its canonical form; null ids or texts are left out."""
    known = df.select(key(id_col).alias("id"), F.col(text_col).alias("text")).dropna().withColumn("same", canonical(F.col("text")))
    wide = lambda c, seed: F.struct(F.xxhash64(c), F.xxhash64(F.lit(seed), c))
    return known.select("id", wide("same", 1).alias("form"), wide("text", 2).alias("text_hash"))


def _several(rows: DataFrame, hot_rows: int) -> DataFrame:
    """The rows whose form occurs with more than one text."""
    forms = rows.groupBy("form").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("form")
    return salted_join(rows, forms, ["form"], "left_semi", F.col("id"), hot_rows)


def look_alike_classes(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, class_id, texts, links): one row per id whose text looks like another one that is not equal to it.

    ``class_id`` is the least id of the class, ``texts`` the number of different texts in it, ``links`` how many ids it is
    linked to (those with another text).
    """
    rows = _several(write_shared(look_alikes(df, id_col, text_col), "looks"), hot_rows).distinct()
    texts = rows.groupBy("form", "text_hash").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    forms = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("texts"), F.sum("copies").alias("ids"))
    sizes = texts.join(forms, "form").select("form", "text_hash", "class_id", "texts", (F.col("ids") - F.col("copies")).alias("links"))
    return salted_join(rows, sizes, ["form", "text_hash"], "inner", F.col("id"), hot_rows).select("id", "class_id", "texts", "links")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: ids whose whole texts look the same but are not equal. Copies of one text are no pair."""
    rows = _several(write_shared(look_alikes(df, id_col, text_col), "looks"), hot_rows).distinct()
    left = rows.select("form", F.col("id").alias("id_1"), F.col("text_hash").alias("hash_1"))
    right = rows.select("form", F.col("id").alias("id_2"), F.col("text_hash").alias("hash_2"))
    pairs = salted_join(left, right, ["form"], "inner", F.col("id_1"), hot_rows)
    return pairs.where((F.col("id_1") < F.col("id_2")) & (F.col("hash_1") != F.col("hash_2"))).select("id_1", "id_2").distinct()
