"""Personal information in free text: generators propose spans, boosted trees judge them, calibrated thresholds select.

The trees see the format of a span, whether its parts are known names, and how its context speaks for or against it; what
contexts say is learned as well. They are fitted on candidates of a bounded sample of documents that are labelled by evidence
they do not see: check digits, titles, sign-offs, schemes and keys, words also written in lower case, numbers that recur in
other documents, dates, versions and code. Candidates without evidence teach nothing. Every document is searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorecast.llm.boosting import Boosted
from lorecast.llm.canonical import Canonicalizer, canonicalizer
from lorecast.llm.sampling import sampled

TYPES = ("email", "phone", "id_number", "address", "person")
EMAIL, PHONE, ID, ADDRESS, PERSON = range(5)
#: The trees are fitted on at most so many documents of at most so many signs.
SAMPLE_DOCS, SAMPLE_SIGNS = 4_000, 50_000
#: A number found in so many documents of the sample is nobody's.
RECURS = 3
#: Rounds in which contexts label what bears no evidence, and the log odds they need for it.
ROUNDS, SURE = 4, 3.0

_CAP = r"[A-ZÀ-ÖØ-ÞŁŠŽ]"
_LETTER = r"[A-Za-zÀ-ÖØ-öø-ɏ]"
_NAME = rf"{_CAP}(?:{_LETTER}|[’'\-](?={_LETTER}))+"
_INITIAL = rf"{_CAP}\.(?:-{_CAP}\.)?"
_TITLE = r"(?:Dr|Prof|Mrs|Mr|Ms|Miss|Mx|Herr|Herrn|Frau|Mme|Mlle|Madame|Monsieur|M|Sir|Dame|Professor|Doktor|Docteur)"
# Words that begin sentences or things, not names.
_NOT_FIRST = frozenset(
    "The A An This That These Those Each Every If When While Note Notes You We They He She It Its On In At By For From To And Or But As All No Not How Why What Which Who Where Using Use Set Build Pi Ticket Item Call Write Ask Please Thanks Questions Every Main Open Default Example Output Under Most Copyright Privacy Terms "
    "Der Die Das Den Dem Des Ein Eine Einen Einem Einer Jeder Jede Jedes Dieser Diese Dieses Wenn Man Mit Bei Beim Im In Am An Auf Aus Für Von Vom Zu Zum Zur Nach Nur Und Oder Aber Wie Was Hinweise Einführung Beispiel Ausgabe Auftrag Weg Steuer Fragen Normalerweise Bis Telefonisch Tel Autor Mein Meine Ich "
    "Le La Les Un Une Des Du De Si Chaque Ce Cette Ces Notez Par Pour Dans Sur En Au Aux Avec Sans Comment Remarques Premiers Exemple Sortie Numéro Appelez Merci Écrivez Utilisez Quand Lorsque Son Sa Ses Il Elle On Et Ou Mais Identity Reviewer Main Telefon Name Namens Nom".split()
)

_AT = r"(?:@| ?[(\[{<] ?(?:at|ät|arobase) ?[)\]}>] ?| at (?=[\w.\-]+ ?(?:[(\[{]dot[)\]}]|dot) ))"
_DOT = r"(?:\.| ?[(\[{<] ?(?:dot|punkt|point) ?[)\]}>] ?| dot )"
_W = r"A-Za-z0-9_À-ÖØ-öø-ÿ"  # signs of words, without those of scripts that put no blank between words
FIND_EMAIL = re.compile(rf"(?<![{_W}.+%'\-])[{_W}.+%'\-]++(?i:{_AT})[{_W}\-]++(?:(?i:{_DOT})[{_W}\-]++)+")
FIND_NUMBER = re.compile(rf"(?<![{_W}.])(?:\+ ?|\()?\d(?:[ ().\-/]{{0,2}}\d)+[Xx]?(?![{_W}])")
FIND_NINO = re.compile(r"\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b")
_TOWN = rf"{_CAP}[\w’'\-]+(?: {_CAP}[\w’'\-]+)*"
_STREET_EN = r"(?:Street|Road|Lane|Avenue|Court|Drive|Boulevard|Way|Place|Terrace|Square|Close|Crescent|Row|Mews|Parkway|St\b\.?|Rd\b\.?|Ln\b\.?|Ave\b\.?|Ct\b\.?|Dr\b\.?|Blvd\b\.?)"
_UNIT = r"(?:,? (?:Apt|Unit|Suite|Ste|Flat|Room|Floor)\b\.? ?#?\w+|,? ?# ?\w+)"
_END_EN = rf"(?:{_UNIT})?(?:, (?!Apt|Unit|Suite){_TOWN})?(?:,? (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})\b)?"
FIND_ADDRESS_EN = re.compile(rf"(?<![\w.])\d{{1,5}}[A-Za-z]? (?:{_CAP}[\w’'\-]+ ){{1,3}}{_STREET_EN}(?![\w]){_END_EN}")
FIND_BOX = re.compile(rf"\b(?:P\. ?O\. ?|PO |P\.O |Post Office )(?:Box|BOX) \d+{_END_EN}")
FIND_BOX_DE = re.compile(rf"\bPostfach \d[\d ]*\d(?:, (?:D-)?\d{{5}} {_TOWN})?")
FIND_ADDRESS_FR = re.compile(
    rf"(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter|quater)\b)?,? (?i:rue|avenue|av\.|place|chemin|boulevard|bd|allée|impasse|quai|route|cours|passage|square|sentier|ruelle|villa)\b"
    rf"(?: (?:de la|de|du|des|le|la|les))*(?: ?[dl][’'])?(?: ?{_CAP}[\w’'\-]*)+(?:,? (?:F-)?\d{{5}} {_TOWN})?"
)
FIND_BOX_FR = re.compile(rf"\b(?:BP|B\.P\.) \d+(?:,? \d{{5}} {_TOWN})?")
FIND_DIGITS = re.compile(r"(?<!\d)\d")
_STREET_DE = tuple("straße strasse str. weg platz gasse allee ring damm ufer bach berg hof markt steig pfad graben wall feld brücke garten park stieg winkel".split())
FIND_ADDRESS_DE = re.compile(
    rf"(?<![\w\-])(?:(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Alte[rns]?|Neue[rns]?|Große[rn]?|Kleine[rn]?|Lange[rn]?|Obere|Untere) )?"
    rf"[A-ZÄÖÜ][\wäöüß\-]*(?:(?<=[\wß])(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|bach|berg|hof|markt|steig|pfad|graben|wall|feld|brücke|garten|park|stieg|winkel)"
    rf"|(?<=Gasse)|(?<=Straße)|(?<=Platz)|(?<=Weg)|(?<=Allee)|(?<=Markt)) \d{{1,4}} ?[a-zA-Z]?(?![\w])(?:, (?:D-)?\d{{5}} {_TOWN}(?: (?:am|an der|im|ob der) {_TOWN})?)?"
)
FIND_ADDRESS_ZH = re.compile(r"([一-鿿]{2,24}(?:路|街|道|巷|弄|里|胡同)(?:[一二三四五六七八九十东南西北中]段)?) ?\d{1,5} ?号(?:楼)?(?: ?\d+ ?(?:栋|幢|座|号楼|弄))?(?: ?\d+ ?单元)?(?: ?\d+ ?(?:室|房|层|楼))*(?:[, ]{0,2}\d{6}(?!\d))?")
_BEFORE_ZH = re.compile(r".*(?:住在|住址|寄到|寄往|寄至|送到|搬到|位于|地址|住|在|到|于|往)")
_MAY_BE_EMAIL = re.compile(r"@|[(\[{<] ?(?:at|ät|arobase) ?[)\]}>]|[(\[{<] ?(?:dot|punkt|point) ?[)\]}>]|dot ", re.I)
_TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms", "Miss", "Mx", "Herr", "Herrn", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "M")
_TITLE_SIGNS = ("Dr", "Prof", "Mr", "Ms", "Miss", "Mx", "Herr", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "M. ", "Sir ", "Dame ", "Doktor", "Docteur")
_NAME_PART = re.compile(rf"{_NAME}|{_INITIAL}")
_HAN = re.compile("[一-鿿]")
FIND_PERSON = re.compile(rf"(?<![{_W}.’\-@/`])(?:{_NAME}|{_INITIAL})(?: (?:{_NAME}|{_INITIAL}))+")
FIND_TITLED = re.compile(rf"(?<![{_W}]){_TITLE}\.? (?={_CAP})((?:{_NAME}|{_INITIAL})(?: (?:{_NAME}|{_INITIAL}))*)")
FIND_REVERSED = re.compile(rf"(?<![{_W}.’\-@/`])({_NAME}), ({_NAME})(?: {_INITIAL})?(?![{_W}’\-])(?! {_CAP})")
FIND_PERSON_ZH = re.compile(
    r"(?:我叫|名叫|叫做|姓名[:是为]? ?|收件人[:]? ?|联系人?[:]? ?|学员[:]? ?|学生[:]? ?|作者[:]? ?|译者[:]? ?|审校[:]? ?|编辑[:]? ?|感谢|由|[一-鿿]和|[a-zA-Z]和|\| ?|[\"“])"
    r"([一-鿿·]{2,4}?)(?=[,。、()|;\"”]| ?\||老师|先生|女士|同学|教授|博士|和|的(?:审校|帮助|支持|补丁|建议)|身份证|邮箱|电话|手机|$|\n| )"
)

_TITLED = re.compile(rf"(?:^|[\s(\[\"“|/])({_TITLE})\.? $")
_M_TITLE = re.compile(r"(?:^|[^\w])(?:et|à|par|de|chez|avec) M\.? $")  # elsewhere the letter may be an initial
_TITLE_AFTER = re.compile("老师|先生|女士|同学|教授|博士")
_KEYED = re.compile(r"(?:tel|phone|telefon|téléphone|mobile|电话|手机号?|whatsapp)[\"']?\s?[.:=]+\s?[\"']?$|tel:$", re.I)
_SHAPES = {
    "ssn": r"\d{3}([ -])\d{2}\1\d{4}|\d{9}", "nino": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", "tin": r"\d{2} \d{3} \d{3} \d{3}|\d{11}",
    "nir": r"[12378] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?", "cnid": r"\d{6}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]",
}
_ID_SHAPES = [re.compile(p) for p in _SHAPES.values()]
_DATED = re.compile(r"(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d|\d{1,2}[./]\d{1,2}[./](?:19|20)\d{2}")
_VERSION = re.compile(r"\d{1,4}(?:\.\d{1,4}){2,3}|\d\.\d{5,}")
_PHONES = [re.compile(p) for p in (
    r"(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}", r"\+\d{1,3}[ \d().\-/]{7,}", r"00\d{2}[ \d().\-/]{7,}", r"\(?0\d{2,5}\)?[ /\-.]?[\d ]{5,10}(?:-\d+)?", r"0\d(?:[ .\-]?\d{2}){4}", r"1[2-9]\d[ -]?\d{4}[ -]?\d{4}", r"[2-9]\d{9}",
)]
FEATURES = 28


def folded(text: str, canon: Canonicalizer | None = None) -> tuple[str, list[int] | None, list[int] | None]:
    """``text`` in its canonical form, with the start and end in ``text`` of each of its signs (None: the same places)."""
    if text.isascii():
        return text, None, None
    canon = canon or canonicalizer()
    table = canon.table
    text, segment = canon.replaced(text)
    out, starts, ends, last = [], [], [], 0
    for m in segment.finditer(text):
        i = max(last, m.start() - 1)  # with the sign before it, which it may join
        out.append(text[last:i])
        starts.extend(range(last, i))
        ends.extend(range(last + 1, i + 1))
        while i < m.end():
            j = i + 1
            while j < m.end() and (unicodedata.combining(text[j]) or table.get(ord(text[j])) == "" and j + 1 < m.end() and unicodedata.combining(text[j + 1])):
                j += 1
            form = canon.normal(text[i:j])
            out.append(form)
            starts.extend([i] * len(form))
            ends.extend([j] * len(form))
            i = j
        last = m.end()
    if not out:
        return text, None, None
    out.append(text[last:])
    starts.extend(range(last, len(text)))
    ends.extend(range(last + 1, len(text) + 1))
    return "".join(out), starts, ends


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans (type, start, end) that may be personal information; they overlap and most are not."""
    found: list[tuple[int, int, int]] = []
    if _MAY_BE_EMAIL.search(text):
        found += [(EMAIL, *m.span()) for m in FIND_EMAIL.finditer(text)]
    for run in FIND_DIGITS.finditer(text):
        _numeric(text, run.start(), found)
    if "Box " in text or "BOX " in text:
        found += [(ADDRESS, *m.span()) for m in FIND_BOX.finditer(text)]
    if "Postfach" in text:
        found += [(ADDRESS, *m.span()) for m in FIND_BOX_DE.finditer(text)]
    if "BP " in text or "B.P." in text:
        found += [(ADDRESS, *m.span()) for m in FIND_BOX_FR.finditer(text)]
    for m in FIND_PERSON.finditer(text):
        s, e = m.span()
        words = m[0].split(" ")
        while words and (words[0] in _NOT_FIRST or words[0].rstrip(".") in _TITLES and words[0] != "M."):
            s += len(words[0]) + 1
            words.pop(0)
        if not words or all(w.endswith(".") for w in words):
            continue
        if len(words) >= 2 and words[0] == "M.":
            found.append((PERSON, s + 3, e))
        if len(words) >= 2:
            found.append((PERSON, s, e))
    if any(title in text for title in _TITLE_SIGNS):
        found += [(PERSON, *m.span(1)) for m in FIND_TITLED.finditer(text) if " " not in m[1] and not m[1].endswith(".")]
    for m in FIND_REVERSED.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()].rsplit("\n", 1)[-1].rsplit(" ", 2)
        part = before[-2] if len(before) > 1 else ""
        if m[1] not in _NOT_FIRST and not (_NAME_PART.fullmatch(part) and part.rstrip(".") not in _TITLES and part != "Ask" and part not in _NOT_FIRST):
            found.append((PERSON, *m.span()))
    if not text.isascii() and _HAN.search(text):
        if "号" in text:
            for m in FIND_ADDRESS_ZH.finditer(text):
                cut = _BEFORE_ZH.match(m[1][:-2])
                found.append((ADDRESS, m.start() + (cut.end() if cut else 0), m.end()))
        found += [(PERSON, *m.span(1)) for m in FIND_PERSON_ZH.finditer(text)]
    return found


def _numeric(text: str, at: int, found: list[tuple[int, int, int]]) -> None:
    """What begins at, or has its first digit at, ``at``."""
    s = at
    while s > 0 and text[s - 1] in "+( " and at - s < 2 and (text[s - 1] != " " or s > 1 and text[s - 2] == "+"):
        s -= 1
    m = FIND_NUMBER.match(text, s) or FIND_NUMBER.match(text, at)
    if m and not any(k in (PHONE, ID) and a < m.start() < b for k, a, b in found[-3:]):
        digits = sum(c.isdigit() for c in m[0])
        if 7 <= digits <= 15:
            found.append((PHONE, m.start(), m.end() - (m[0][-1] in "Xx")))
        if digits >= 9 and any(p.fullmatch(m[0]) for p in _ID_SHAPES):
            found.append((ID, *m.span()))
    for s in (at - 2, at - 3):
        if s >= 0 and (m := FIND_NINO.match(text, s)):
            found.append((ID, *m.span()))
    for find in (FIND_ADDRESS_EN, FIND_ADDRESS_FR):
        if m := find.match(text, at):
            found.append((ADDRESS, *m.span()))
    if at and text[at - 1] == " " and text[max(0, at - 9) : at - 1].lower().endswith(_STREET_DE):
        for m in FIND_ADDRESS_DE.finditer(text, max(0, at - 60), min(len(text), at + 90)):
            if m.start() < at < m.end():
                found.append((ADDRESS, *m.span()))


_CONTEXT = re.compile(r"[一-鿿]|[^\W\d_]+|\d+|[^\w\s]|\n")


def _masked(words: list[str]) -> str:
    """``words`` with capitalized ones all alike."""
    return " ".join("0" if w.isdigit() else "X" if w[0].isupper() else w for w in words)


def context_words(text: str, s: int, e: int) -> list[str]:
    """What stands around a span, as words with their place: three before it, two after it, and both sides with names alike."""
    before = ["^", "^", "^", *_CONTEXT.findall(text[max(0, s - 40) : s])][-3:]
    after = [*_CONTEXT.findall(text[e : e + 30]), "$", "$"][:2]
    a, b, c = ("0" if w.isdigit() else w.lower() for w in before)
    d, f = ("0" if w.isdigit() else w.lower() for w in after)
    return ["1" + c, "2" + b + " " + c, "3" + a + " " + b + " " + c, "4" + b, "8" + _masked(before[1:]), "5" + d, "6" + d + " " + f, "9" + _masked(after), "7" + c + " " + d]


class Contexts:
    """How much each context word of a type of span speaks for it: log odds from labelled spans, seen in at least two documents."""

    def __init__(self):
        self.seen: dict[tuple, list] = defaultdict(lambda: [0, 0])
        self.odds: dict[tuple, float] = {}

    def add(self, kind: int, words: list[str], label: int) -> None:
        for w in words:
            self.seen[kind, w][label] += 1

    def made(self) -> Contexts:
        self.odds = {k: float(np.log((p + 0.5) / (n + 0.5))) for k, (n, p) in self.seen.items() if n + p >= 2}
        self.seen = {}
        return self

    def score(self, kind: int, words: list[str]) -> tuple[float, float, float]:
        """What the words before the span say, those after it, and both together."""
        v = [self.odds.get((kind, w), 0.0) for w in words]
        return sum(v[:5]), sum(v[5:8]), sum(v)


class Lines:
    """Where lines and code marks of a text are, found once."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
        self.marks = [m.start() for m in re.finditer("`", text)]

    def of(self, s: int, e: int) -> tuple[int, int]:
        """The beginning of the line of ``s`` and the end of that of ``e``."""
        i = bisect_left(self.ends, s)
        return self.ends[i - 1] + 1 if i else 0, self.ends[bisect_left(self.ends, e)]

    def in_code(self, start: int, s: int) -> bool:
        return (bisect_left(self.marks, s) - bisect_left(self.marks, start)) % 2 == 1


def features(text: str, found: list[tuple[int, int, int]], names: frozenset, contexts: Contexts) -> np.ndarray:
    """Format and context of each candidate; ``names`` and ``contexts`` are what the sample taught."""
    x = np.zeros((len(found), FEATURES), np.float32)
    if not found:
        return x
    lines, mails = Lines(text), sorted(s for kind, s, _ in found if kind == EMAIL)
    for row, (kind, s, e) in zip(x, found):
        span = text[s:e]
        line0, line1 = lines.of(s, e)
        groups = re.findall(r"\d+", span)
        digits = sum(map(len, groups))
        row[0:8] = kind, e - s, digits, len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, digits / (e - s)
        row[8:11] = span[0] == "+", span[0] == "(", span[0] == "0"
        row[11] = sum(1 << i for i, c in enumerate(" -./") if c in span) if kind in (PHONE, ID) else 0
        row[12:15] = contexts.score(kind, context_words(text, s, e))
        row[15] = line0 >= s - 4 and not text[line0:s].strip("-*# |")
        row[16] = row[15] and line1 <= e + 4 and not text[e:line1].strip(" .,|")
        row[17] = text[line0 : line0 + 1] in ("|", "{")
        near = bisect_left(mails, s - 120)
        row[18] = near < len(mails) and mails[near] < e + 120
        if kind in (PHONE, ID):
            row[19] = next((i + 1 for i, p in enumerate(_ID_SHAPES) if p.fullmatch(span)), 0)
            row[20] = next((i + 1 for i, p in enumerate(_PHONES) if p.fullmatch(span)), 0)
            row[21] = s > 0 and text[s - 1] in "=_#$"
        elif kind == PERSON:
            parts = re.findall(r"[^\W\d_][\w’'\-]*\.?", span)
            full = [p for p in parts if not p.endswith(".")]
            row[19:23] = len(parts), len(parts) - len(full), span.isupper(), ", " in span
            row[23] = sum(p.lower() in names for p in full) / max(1, len(full))
            row[24] = "一" <= span[0] <= "鿿"
            row[25] = text[max(0, s - 3) : s] == "M. " or span.startswith("M. ") and 2
        elif kind == ADDRESS:
            row[19:22] = span.count(","), bool(re.search(r"\b\d{5}\b", span)), "号" in span
            row[22] = len(re.findall(r"[^\W\d_]{2,}", span))
        else:
            tail = re.split(r"(?i)\.|dot|punkt|point", span)[-1].strip(" )]}>")
            row[19:21] = tail.isalpha() and len(tail) >= 2, "@" in span
    return x


def checked(digits: str) -> bool | None:
    """Whether the check digits of a national number are right; None if it is of no kind that has any."""
    if re.fullmatch(r"\d{17}[\dXx]", digits):  # Chinese identity numbers
        weights = [2 ** (17 - i) % 11 for i in range(17)]
        return "10X98765432"[sum(w * int(d) for w, d in zip(weights, digits)) % 11] == digits[17].upper()
    if re.fullmatch(r"[12378]\d{4}(?:\d{2}|2[AB])\d{8}", digits):  # French social security numbers with key
        number = int(digits[:13].replace("2A", "19").replace("2B", "18"))
        return 97 - number % 97 == int(digits[13:])
    if re.fullmatch(r"\d{11}", digits):  # German tax numbers
        product = 10
        for d in digits[:10]:
            product = ((int(d) + product) % 10 or 10) * 2 % 11
        return (11 - product) % 10 == int(digits[10])
    return None


def evidence(text: str, found: list[tuple[int, int, int]], words: frozenset, recurring: frozenset) -> list[int]:
    """1 or 0 where something that the trees don't see tells what a candidate is, else -1."""
    lines, out = Lines(text), []
    for kind, s, e in found:
        span = text[s:e]
        line0, line1 = lines.of(s, e)
        above = text[max(0, line0 - 5) : line0].strip()
        signed = line0 >= s - 2 and (above == "--" or above.endswith("\n--"))
        code, compact = lines.in_code(line0, s), _compact(span)
        if kind == EMAIL:
            tail = re.split(r"(?i)\.|dot|punkt|point", span)[-1].strip(" )]}>")
            label = int(tail.isalpha() and len(tail) >= 2)
        elif code or kind != PERSON and compact in recurring:
            label = 0
        elif kind in (PHONE, ID):
            valid, national = checked(compact), bool(FIND_NINO.fullmatch(span)) or bool(re.fullmatch(r"\d{3}([ -])\d{2}\1\d{4}", span))
            if _DATED.match(span) or _VERSION.fullmatch(span) and not re.fullmatch(_PHONES[0], span) or s and text[s - 1] in "_#$" or re.search(r"\w=$", text[max(0, s - 2) : s]) and not _KEYED.search(text[max(0, s - 14) : s]):
                label = 0
            elif kind == ID:
                label = int(valid) if valid is not None else 1 if national else 0 if any(p.fullmatch(span) for p in _PHONES[1:5]) or _KEYED.search(text[max(0, s - 14) : s]) else -1
            elif valid or national or not any(p.fullmatch(span) for p in _PHONES):
                label = 0
            else:
                label = 1 if span[0] in "+(" or span.startswith("00") or _KEYED.search(text[max(0, s - 14) : s]) or signed else -1
        elif kind == ADDRESS:
            label = 1 if re.search(r"\b\d{5,6}\b|(?i:box|postfach|bp) \d|[A-Z]\d[A-Z\d]? ?\d[A-Z]{2}\b|\d ?(?:单元|室|栋|幢)|(?:Apt|Unit|Suite|Flat|#)\b", span) or signed else -1
        else:
            parts = [p.lower() for p in re.findall(r"[^\W\d_][\w’'\-]+", span)]
            if text[max(0, s - 3) : s] != "M. " and span.startswith("M. ") and re.search(r"(?:et|à|par|de) $", text[max(0, s - 4) : s]):
                label = 0  # the letter is a title here
            else:
                title = _TITLED.search(text[max(0, s - 12) : s])
                label = 1 if title and (title[1] != "M" or _M_TITLE.search(text[max(0, s - 9) : s])) or _TITLE_AFTER.match(text, e) or signed else 0 if any(p in words for p in parts) or compact + "!" in recurring else -1
        out.append(label)
    return out


def _compact(span: str) -> str:
    return re.sub(r"[^\w+]", "", span)


def _fixed(texts: list[str], spans: list[list[tuple[int, int, int]]], recurring: frozenset) -> frozenset:
    """Recurring phrases that only look like names: their words never occur with others, or the phrase never between others."""
    partners, between = defaultdict(set), defaultdict(set)
    people = [(_compact(t[s:e]) + "!", re.findall(r"[^\W\d_][\w’'\-]+", t[s:e]), context_words(t, s, e)[-1]) for t, c in zip(texts, spans) for kind, s, e in c if kind == PERSON]
    for phrase, parts, around in people:
        between[phrase].add(around)
        for p in parts:
            partners[p].add(phrase)
    return frozenset(phrase for phrase, parts, _ in people if phrase in recurring and (len(between[phrase]) == 1 if len(parts) == 1 else parts and all(len(partners[p]) == 1 for p in parts)))


def _lowered(texts: list[str]) -> frozenset:
    """Words that the sample has in lower case."""
    seen: Counter = Counter()
    for t in texts:
        t = FIND_EMAIL.sub(" ", t)
        seen.update(set(re.findall(r"(?<![\w’'\-@.])[a-zà-ÿß]{2,}", t)))
    return frozenset(w for w, n in seen.items() if n >= 2)


class Judge:
    """Names and contexts of the sample, trees, and a threshold per type: all that tasks need."""

    def __init__(self, texts: list[str], seed: int = 7):
        texts = [folded(t)[0] for t in texts if t]
        spans = [candidates(t) for t in texts]
        words = _lowered(texts)
        places = Counter(v for t, c in zip(texts, spans) for v in {_compact(t[s:e]) + "!" * (kind == PERSON) for kind, s, e in c})
        recurring = frozenset(v for v, n in places.items() if n >= RECURS)
        numbers = frozenset(v for v in recurring if v[-1] != "!")
        nobody = numbers | _fixed(texts, spans, recurring)
        labels = [evidence(t, c, words, nobody) for t, c in zip(texts, spans)]
        part = np.random.default_rng(seed).integers(0, 4, len(texts))  # each part's contexts are judged by what the others teach
        around = [[context_words(t, s, e) for _, s, e in c] for t, c in zip(texts, spans)]
        for turn in range(ROUNDS):
            self.names, contexts = self._taught(texts, spans, labels, around, part, words)
            if turn + 1 < ROUNDS:
                labels = [[self._more(t, c[i], v, contexts[of], w[i]) if v < 0 else v for i, v in enumerate(y)] for t, c, y, w, of in zip(texts, spans, labels, around, part)]
        self.contexts = contexts[4]
        rows = [features(t, c, self.names, contexts[of]) for t, c, of in zip(texts, spans, part)]
        x = np.concatenate([r for r in rows if len(r)] or [np.zeros((0, FEATURES), np.float32)])
        y = np.array([v for ys in labels for v in ys], int)
        if len(y) and (y < 0).all():
            raise ValueError("no candidate of the sample bears evidence from which trees could be fitted")
        sure, held = y >= 0, (np.repeat(part, [len(r) for r in rows]) == 0) if len(texts) > 3 else np.zeros(len(y), bool)
        fit, test = sure & ~held, sure & held
        self.trees = Boosted().fit(x[fit], y[fit]).calibrate(x[test], y[test])
        p = self.trees.probability(x[test])
        self.limits, self.held_out = np.full(len(TYPES), 0.5), {}
        for k, name in enumerate(TYPES):
            of = x[test][:, 0] == k
            if of.sum() < 20:
                continue
            best = max(np.linspace(0.2, 0.8, 13), key=lambda c: (_f1(p[of] >= c, y[test][of]), -abs(c - 0.5)))
            self.limits[k], self.held_out[name] = best, _f1(p[of] >= best, y[test][of])

    @staticmethod
    def _taught(texts, spans, labels, around, part, words) -> tuple[frozenset, list[Contexts]]:
        """The parts of names, and the contexts that each part of the sample lacks (the last are those of all)."""
        names: set[str] = set()
        contexts = [Contexts() for _ in range(5)]
        for t, c, y, w, of in zip(texts, spans, labels, around, part):
            for (kind, s, e), v, ws in zip(c, y, w):
                if v >= 0 and not (kind == PERSON and t.startswith("M. ", s)):  # the context of a title is that of the name after it
                    for k in range(5):
                        if k != of:
                            contexts[k].add(kind, ws, v)
                    if v and kind == PERSON:
                        names.update(p.lower() for p in re.findall(r"[^\W\d_][\w’'\-]+", t[s:e]))
        return frozenset(n for n in names if n not in words), [c.made() for c in contexts]

    def _more(self, text: str, span: tuple[int, int, int], label: int, contexts: Contexts, around: list[str]) -> int:
        """A label for a candidate without evidence: from its context, or if it is a name from names known by now."""
        kind, s, e = span
        score = contexts.score(kind, around)[2]
        if kind != PERSON:
            return 1 if score >= SURE else 0 if score <= -SURE else label
        parts = [p.lower() for p in re.findall(r"[^\W\d_][\w’'\-]+", text[s:e])]
        known = sum(p in self.names for p in parts)
        return 1 if score >= SURE or known and (known == len(parts) and " " in text[s:e] or score + SURE * known >= SURE) else label

    def select(self, docs: list[list[tuple[int, int, int]]], x: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Of each document's candidates those over their threshold, the surest first, none over another."""
        p = self.trees.probability(x) if len(x) else np.zeros(0)
        out, at = [], 0
        for found in docs:
            sure = [(kind != EMAIL, -(min(q, 0.97) + 0.0001 * (e - s)), s, e, kind) for (kind, s, e), q in zip(found, p[at : at + len(found)]) if q >= self.limits[kind]]
            at += len(found)
            taken: list[tuple[int, int, int]] = []  # by start; as none overlaps, only the neighbours can
            for _, _, s, e, kind in sorted(sure):
                i = bisect_right(taken, (s, e, 9))
                if (not i or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                    insort(taken, (s, e, kind))
            out.append([(kind, s, e) for s, e, kind in taken])
        return out


def _f1(got: np.ndarray, want: np.ndarray) -> float:
    hit = float((got & (want > 0)).sum())
    return 2 * hit / max(1.0, got.sum() + want.sum())


def fitted(df: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> Judge:
    """A judge from the ``sample_docs`` documents with the least hash of their id, of up to ``SAMPLE_SIGNS`` signs (a bound on what is fitted, not on what is searched)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = sampled(docs.where(F.length("text").between(1, SAMPLE_SIGNS)), "id", sample_docs, "pii", docs.select("id").count())  # counted from the files' footers
    return Judge(sorted(r.text for r in rows))


def _places(text: str, spans: list[tuple[int, int, int]], starts, ends) -> list[tuple[int, int, int]]:
    return spans if starts is None else [(k, starts[s], ends[e - 1]) for k, s, e in spans]


def _searched(judge, carry: int, schema: pa.Schema, whole: bool):
    canon = canonicalizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j: Judge = judge.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(carry).to_pylist()]
                forms = [folded(t, canon) for t in texts]
                found = [candidates(f) for f, _, _ in forms]
                x = [features(f, c, j.names, j.contexts) for (f, _, _), c in zip(forms, found)]
                chosen = j.select(found, np.concatenate([r for r in x if len(r)] or [np.zeros((0, FEATURES), np.float32)]))
                places = [_places(t, c, s, e) for t, c, (_, s, e) in zip(texts, chosen, forms)]
                ids = pa.array(np.repeat(np.arange(len(texts)), [1 if whole else len(p) for p in places]).astype(np.int64))
                carried = [part.column(k).take(ids) for k in range(carry)]
                if whole:
                    made = [pa.array([_redacted(t, p) for t, p in zip(part.column(carry).to_pylist(), places)], pa.string())]
                else:
                    flat = [p for ps in places for p in ps]
                    made = [pa.array([TYPES[k] for k, _, _ in flat], pa.string()), pa.array([s for _, s, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*carried, *made], schema)], schema=schema)

    return run


def _redacted(text: str | None, places: list[tuple[int, int, int]]) -> str | None:
    if not places:
        return text
    out, last = [], 0
    for k, s, e in places:
        out += [text[last:s], f"[{TYPES[k].upper()}]"]
        last = e
    return "".join(out) + text[last:]


def _run(df: DataFrame, carry: Sequence[str], text_col: str, fields: list[T.StructField], whole: bool, judge: Judge | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    shared = df.sparkSession.sparkContext.broadcast(judge or fitted(df, carry[0], text_col))  # of the sample's size, not the corpus'
    inner = [f"c{i}" for i in range(len(carry))]
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(carry, inner)), F.col(text_col).alias("_text"))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in carry), *fields])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    return rows.mapInArrow(_searched(shared, len(carry), arrow, whole), schema)


def found_pii(df: DataFrame, carry: Sequence[str], text_col: str, judge: Judge | None = None) -> DataFrame:
    """The columns ``carry`` (the id first) with pii_type, start_char, end_char: one row per place, in code points from 0.

    Null and empty texts have no places; repeated rows give repeated places; places of one text never overlap.
    """
    fields = [T.StructField("pii_type", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]
    return _run(df, carry, text_col, fields, False, judge)


def redacted(df: DataFrame, carry: Sequence[str], text_col: str, name: str = "text", judge: Judge | None = None) -> DataFrame:
    """The columns ``carry`` and the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [PERSON] in place of the places
    that ``found_pii`` gives, all else unchanged; null stays null."""
    return _run(df, carry, text_col, [T.StructField(name, T.StringType())], True, judge)
