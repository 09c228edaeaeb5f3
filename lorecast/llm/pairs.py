"""Broken question-answer pairs: empty, copied, refusing, truncated answers and answers in another language.

Languages are told apart by naive Bayes over character n-grams, truncation by how likely a text is to end after its last
n-grams, and clauses that give content from those that decline by naive Bayes too. All models are tables of fixed size:
n-grams are hashed. Texts of a batch are hashed together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecast.functions.keys import key
from lorecast.llm.canonical import canonical, canonicalizer
from lorecast.llm.sampling import sampled
from lorecast.session import write_shared

LANGUAGES = ("en", "zh", "de", "fr")
#: The language model is fitted on at most so many labelled documents and questions, each of a length between these.
SAMPLE_DOCS = 4_000
SAMPLE_SIGNS = (40, 20_000)
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: A text with a lower likelihood of ending where it ends is truncated.
END_LIKELIHOOD = 0.02
#: The question's language must be this many times likelier for the question than for the answer, and the answer's the other way.
LANGUAGE_ODDS = 20.0
#: With fewer plain refusals than this there is no model of refusals.
LEAST_REFUSALS = 20
#: So many signs of a batch are hashed at a time (a longer text is hashed whole).
PIECE_SIGNS = 1_000_000

# Labels before a copied question, placeholders, and what refusals say.
_LABELS = r"^(?:(?:q|a|question|answer|frage|antwort|réponse|reponse|问题|问|答案|答|回答|re|aw|copy|prompt|response)\s*[:.\-)]\s*|>\s*|#+\s*|[*_\"'“”«»]+\s*)+"
_PLACEHOLDERS = (
    "n/a", "na", "n.a.", "tbd", "tba", "tbc", "todo", "to do", "fixme", "wip", "pending", "placeholder", "lorem ipsum", "to be added", "to be done", "to be determined", "coming soon", "answer here", "your answer here", "add answer", "insert answer here", "no answer yet", "answer to follow", "to follow", "xxx", "null", "nil", "undefined", "nan",
    "待补充", "待定", "待填写", "待完善", "待更新", "待添加", "暂无", "暂无答案", "无", "空", "稍后补充", "未填写", "folgt", "folgt noch", "folgt später", "noch offen", "wird nachgereicht", "wird ergänzt", "offen", "entfällt", "platzhalter", "keine angabe", "k.a.", "k. a.", "à compléter", "a completer", "à venir", "à définir", "à remplir", "non renseigné", "néant", "en attente",
)
_REFUSALS = (
    r"can(?:no|')?t help (?:you )?with|cannot help|can't (?:answer|assist|provide|respond|discuss|comment)|cannot (?:answer|assist|provide|respond|discuss|fulfil)|unable to (?:answer|assist|help|provide|respond)|not able to (?:answer|assist|help|provide|give|respond)|won't be able to|(?:i )?(?:do not|don't) (?:know|have (?:an answer|enough|that|any))|no idea|not sure (?:about|how)"
    r"|(?:not|in)(?: enough|sufficient) (?:context|information)|do(?:es)? not contain an answer|no (?:relevant|matching) (?:material|content|information|results?|passages?|documents?)|(?:outside|beyond) (?:what|the scope|my)|as an? (?:ai|language|virtual)[\w ]*(?:model|assistant)|could not find|couldn't find|did not find|nothing (?:was )?found|not allowed to|must decline|have to decline"
    r"|无法(?:回答|提供|协助|帮助|处理|确定)|不能(?:回答|提供|协助|帮助|讨论)|不知道|不清楚|不了解|没有(?:找到|答案|相关|足够)|未找到|找不到|超出了?我|作为(?:一个)?(?:语言|人工智能|ai)|上下文不足|信息不足|拒绝回答|爱莫能助|资料不足"
    r"|nicht (?:beantworten|helfen|weiterhelfen|sagen|bereitstellen|beurteilen)|weiß (?:ich|es) (?:das |es )?nicht|(?:ich )?weiß (?:das|es) (?:leider )?nicht|keine (?:antwort|angaben|auskunft|passenden|informationen|ergebnisse|relevanten)|fehlt mir|darf ich (?:dazu|das|darüber) nicht|als (?:sprach|ki)\S*|nichts (?:gefunden|passendes|dazu)|außerhalb (?:meine|dessen|des)|nicht genug (?:kontext|informationen)"
    r"|ne (?:peux|puis|sais|suis) pas|ne (?:peux|puis) (?:malheureusement )?(?:pas )?(?:répondre|aider|fournir)|pas (?:en mesure|assez|de réponse|suffisamment)|ne contiennent pas|ne contient pas|contexte est insuffisant|aucun(?:e)? (?:résultat|contenu|information|réponse|élément|passage|document)|en tant qu'(?:assistant|ia|intelligence|modèle)|(?:dépasse|sort du|hors d[ue]) |impossible de répondre|n'ai (?:pas|rien) trouvé"
)
_CODE = r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)"
_INLINE = r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,200}>"


class Grams:
    """The hashed n-grams of several texts, none of them empty: ``buckets[k]`` has those of order k + 1 that end at each sign.

    ``states`` gives a number per sign of all texts, by which n-grams differ (within code or not).
    """

    def __init__(self, texts: list[str], states: np.ndarray | None = None, orders: int = len(ORDERS)):
        signs = np.frombuffer("".join("\x02\x02\x02" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.repeat(3 * np.arange(1, len(texts) + 1), self.lengths) + np.arange(self.lengths.sum())
        self.signs = signs[at]
        h = np.zeros(len(at), np.uint64) if states is None else states.astype(np.uint64) * np.uint64(0x9E3779B1)
        self.buckets = []
        for k in range(orders):
            h = h * np.uint64(0x100000001B3) + signs[at - k]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.buckets.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``values`` per sign added up per text."""
        return np.add.reduceat(values, self.starts, axis=0)


def pieces(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``PIECE_SIGNS`` signs."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_SIGNS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def code_states(texts: list[str]) -> np.ndarray:
    """1 for each sign within a fenced block, the opening fence included, the closing one not."""
    out = []
    for text in texts:
        state = np.zeros(len(text), np.uint8)
        if "```" in text or "~~~" in text:
            last, inside = 0, False
            for m in re.finditer(r"```|~~~", text):
                if inside:
                    state[last : m.end() - 1] = 1
                last, inside = m.start(), not inside
            if inside:
                state[last:] = 1
        out.append(state)
    return np.concatenate(out)


def counted(texts: list[str]) -> np.ndarray:
    """(3, buckets): how often the n-grams of order 1 to 3 occur in ``texts``."""
    out = np.zeros((3, BUCKETS), np.int64)
    texts = [t for t in texts if t]
    for part in pieces(texts):
        for k, b in enumerate(Grams(texts[part], orders=3).buckets):
            out[k] += np.bincount(b, minlength=BUCKETS)
    return out


class Bayes:
    """Naive Bayes over hashed character n-grams of order 1 to 3, from their counts in each class."""

    def __init__(self, counts: np.ndarray, smooth: float = 0.05):
        counts = counts + smooth
        self.logs = np.ascontiguousarray(np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32).transpose(1, 2, 0))

    def posteriors(self, grams: Grams) -> np.ndarray:
        """(texts, classes): log posteriors under equal priors; neighbouring n-grams share evidence, so it is damped."""
        per_sign = sum(logs[b] for logs, b in zip(self.logs, grams.buckets))
        score = grams.sums(per_sign.astype(np.float64)) / 3
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


class Languages(Bayes):
    """The languages as classes."""

    def __init__(self, texts: list[tuple[str, str]]):
        super().__init__(np.stack([counted([t for lang, t in texts if lang == name]) for name in LANGUAGES]))

    def posterior(self, prose: str) -> np.ndarray:
        return self.posteriors(Grams([prose], orders=3))[0]


def fitted_languages(documents: DataFrame, texts: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> Languages:
    """A language model from at most ``sample_docs`` labelled documents of ``SAMPLE_SIGNS``; wrong labels are few.

    Questions are put otherwise than documents: given ``texts`` (qa_id, q, a), as many questions are added under the language
    of their answer where the documents alone leave no doubt about it; nearly all pairs are in one language. The sample bounds
    what is fitted, not what is judged; documents none of which is labelled are an error.
    """
    total = documents.count()
    docs = documents.where(F.lower("lang").isin(*LANGUAGES) & F.length("text").between(*SAMPLE_SIGNS)).select("id", F.lower("lang").alias("lang"), "text")
    bare = lambda t: re.sub(r"[\s\d]+", " ", re.sub(_INLINE, " ", re.sub(_CODE, " ", t))).lower()
    form = canonicalizer()
    known = [(r.lang, bare(form(r.text))) for r in sampled(docs, "id", sample_docs, "lang", total)]
    if total and not known:
        raise ValueError("no document has a known language and a text from which it could be learned")
    model = Languages(known)
    if texts is None or not known:
        return model
    asked = sampled(texts.where((F.length("a") <= SAMPLE_SIGNS[1]) & (F.length("q") <= SAMPLE_SIGNS[1])), "qa_id", sample_docs, "lang", texts.count())
    for r in asked:
        q, a = bare(r.q), bare(r.a)
        if sum(c.isalpha() for c in a) >= 20 and q:
            p = model.posterior(a)
            first, second = np.argsort(p)[:-3:-1]
            if p[first] - p[second] > 20:
                known.append((LANGUAGES[first], q))
    return Languages(known)


def _prose(text: Column) -> Column:
    """``text`` without code, identifiers, links and tags, lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, _CODE, " "), _INLINE, " ")
    return F.lower(F.regexp_replace(bare, r"[\s\d]+", " "))


_BROKEN_OFF = re.compile(r"(?:[,;:(\[{\-–—/&+=<、]|\.\.\.|…|\n\s*(?:\d{1,3}[.)]|[-*•]))$")


def _closed(text: str) -> bool:
    """No open bracket or code block, and no sign at the end that promises more: only such texts teach what ends look like."""
    return not _BROKEN_OFF.search(text[-40:]) and text.count("(") <= text.count(")") and text.count("```") % 2 == 0


class Counts:
    """What all answers have: n-grams and closed ends after them (``inside``, ``ends``), and those of content and of plain refusals."""

    def __init__(self):
        self.table = np.zeros((2 * len(ORDERS) + 2 * 3, BUCKETS), np.int64)
        self.inside, self.ends = self.table[: len(ORDERS)], self.table[len(ORDERS) : 2 * len(ORDERS)]
        self.clauses = self.table[2 * len(ORDERS) :].reshape(2, 3, BUCKETS)
        self.refusals = 0

    def refusing(self) -> Bayes | None:
        return Bayes(self.clauses) if self.refusals >= LEAST_REFUSALS else None


def answer_counts(texts: DataFrame) -> Counts:
    """Counts over all answers of ``texts`` (a, prose, refuses). Tasks add up their rows first; what comes together has the tables' fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, refusals = Counts(), 0
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if r[0]]
            answers = [r[0] for r in rows]
            for part in pieces(answers):
                some = answers[part]
                g = Grams(some, code_states(some))
                closed = np.array([_closed(t) for t in some])
                last = g.starts + g.lengths - 1
                for k, b in enumerate(g.buckets):
                    seen.inside[k] += np.bincount(b, minlength=BUCKETS)
                    seen.ends[k] += np.bincount(b[last[closed]], minlength=BUCKETS)
            seen.clauses[0] += counted([prose for _, prose, refuses in rows if not refuses])
            plain = [prose for a, prose, refuses in rows if refuses and "`" not in a]  # where no code is named, what sounds like a refusal is one
            seen.clauses[1] += counted(plain)
            refusals += len(plain)
        flat = seen.table.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"at": np.append(at, -1), "n": np.append(flat[at], refusals)})

    got = texts.select("a", "prose", "refuses").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = Counts()
    inner = got[got["at"] >= 0]
    out.table.ravel()[inner["at"].to_numpy()] = inner["n"].to_numpy()
    out.refusals = int(got[got["at"] < 0]["n"].sum())
    return out


def end_likelihoods(texts: list[str], counts: Counts, weight: float = 8.0) -> np.ndarray:
    """How likely each text is to end after its last n-grams; the text itself is left out of the counts."""
    out = np.ones(len(texts))
    for part in pieces(texts):
        some = texts[part]
        g = Grams(some, code_states(some))
        own = np.array([_closed(t) for t in some], np.int64)
        last = g.starts + g.lengths - 1
        p = np.maximum(counts.ends[0].sum() - own, 1) / np.maximum(counts.inside[0].sum() - g.lengths, 1)
        for k, b in enumerate(g.buckets):
            tail = b[last]
            n = counts.inside[k, tail] - g.sums(b == np.repeat(tail, g.lengths))
            p = (np.maximum(counts.ends[k, tail] - own, 0) + weight * p) / (np.maximum(n, 0) + weight)
        out[part] = p
    return out


_ALPHA = np.array([chr(i).isalpha() for i in range(0x30000)])
_CLAUSES = re.compile(r"[.!?;:,。！？；：，…\n]+|\b(?:but|however|aber|mais|jedoch)\b|但是?|不过")


def foreign(questions: list[str], answers: list[str], model: Languages) -> np.ndarray:
    """Whether the prose of an answer is in another language than that of its question; texts with few letters tell nothing."""
    out = np.zeros(len(questions), bool)
    odds, likely = np.log(LANGUAGE_ODDS), []
    both = [i for i, (q, a) in enumerate(zip(questions, answers)) if q and a]
    for texts, least in (([questions[i] for i in both], 4), ([answers[i] for i in both], 12)):
        p, enough = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts), bool)
        for part in pieces(texts):
            g = Grams(texts[part], orders=3)
            p[part] = model.posteriors(g)
            letters = _ALPHA[np.minimum(g.signs, len(_ALPHA) - 1)] * np.where((g.signs > 0x2E80) & (least > 4), 2, 1)
            enough[part] = g.sums(letters) >= least
        likely.append((p, enough))
    (p, some), (r, more) = likely
    if both:
        i, j, row = p.argmax(1), r.argmax(1), np.arange(len(both))
        out[both] = some & more & (i != j) & (p[row, i] - p[row, j] > odds) & (r[row, j] - r[row, i] > odds)
    return out


def declines(prose: str, model: Bayes) -> bool:
    """Whether every clause of an answer that sounds like a refusal is likelier among refusals than among answers with content."""
    clauses = [c for c in _CLAUSES.split(prose) if sum(x.isalpha() for x in c) >= 3]
    if not clauses:
        return True
    p = model.posteriors(Grams(clauses, orders=3))
    return bool((p[:, 1] > p[:, 0]).all())


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def pair_texts(pairs: DataFrame) -> DataFrame:
    """(qa_id, q, a, prose, refuses, plain): each pair once, both texts in canonical form without blanks around them.

    ``prose`` is the answer without code, ``refuses`` says that it sounds like a refusal, ``plain`` is the defect that needs no
    model. Null answers stay null. Written to the shared folder, as the counts and the judgement both read it.
    """
    once = pairs.select(key("id").alias("qa_id"), F.col("question").alias("q"), F.col("reference_answer").alias("a")).where("qa_id is not null").dropDuplicates(["qa_id"])
    trim = lambda c: F.btrim(canonical(F.col(c)), F.lit(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029\u2800"))  # noqa: E731 - the other blanks are gone or spaces
    once = once.select("qa_id", trim("q").alias("q"), trim("a").alias("a"))
    unquoted = F.regexp_replace(F.regexp_replace(F.lower("a"), "[’‘´]", "'"), "\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|`[^`\n]*`", " ")
    made = once.select("*", _prose(F.col("a")).alias("prose"), F.coalesce(unquoted.rlike(_REFUSALS), F.lit(False)).alias("refuses"), plain_defect(F.col("q"), F.col("a")).alias("plain"))
    return write_shared(made, "pairs")


def plain_defect(q: Column, a: Column) -> Column:
    """empty or copy, or null: what can be told without a model."""
    bare = F.regexp_replace(F.regexp_replace(a, r"<[^<>]{1,200}>|&(?:nbsp|zwnj|zwj|ensp|emsp|#160|#8203);", ""), r"```[\w+\-]*\s*```|~~~\s*~~~", "")
    word = F.lower(F.regexp_replace(bare, r"^[\s\[\](){}<>*_#.…!\"'“”:\-–—]+|[\s\[\](){}<>*_#.…!\"'“”:\-–—]+$", ""))
    empty = a.isNull() | ~bare.rlike(r"[\p{L}\p{N}\p{S}&&[^`~|^+<>=$]]|(?<!`)`[^`\n]*[^`\s][^`\n]*`") | word.isin(*_PLACEHOLDERS)
    unlabelled = F.regexp_replace(F.lower(a), _LABELS, "")
    asked = _letters(q)
    repeats = lambda t: (_letters(t) != "") & (F.replace(_letters(t), asked, F.lit("")) == "")
    each_line = F.regexp_replace(F.lower(a), r"(?m)" + _LABELS, "")
    copy = (asked != "") & _letters(a).contains(asked) & (repeats(unlabelled) | repeats(a) | repeats(each_line))
    return F.when(empty, "empty").when(copy, "copy")


def _judge(languages, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refusing = counts.value.refusing()
        for batch in batches:
            ids, q, a, prose, refuses = (c.to_pylist() for c in batch.columns)
            other = foreign([x or "" for x in q], [x or "" for x in prose], languages.value)
            broken = end_likelihoods(a, counts.value) < END_LIKELIHOOD
            found = []
            for i in range(len(ids)):
                if refuses[i] and (declines(prose[i], refusing) if refusing else "`" not in a[i]):
                    found.append("refusal")
                else:
                    found.append("other_language" if other[i] else "truncated" if broken[i] else None)
            at = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_pydict({"qa_id": pa.array([ids[i] for i in at], pa.string()), "defect": pa.array([found[i] for i in at], pa.string())})

    return run


def defective_pairs(pairs: DataFrame, documents: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(qa_id, defect): one row per defective pair; the first of empty, copy, refusal, other_language, truncated that holds.

    Null answers are empty; a null or blank question can neither be copied nor be of another language; pairs written several
    times count once; an empty table gives no rows; texts of any length are judged whole. The models see only pairs that are
    neither empty nor copied. Where the table has too few refusals for a model, what sounds like one and names no code is one.
    """
    texts = pair_texts(pairs)
    context = pairs.sparkSession.sparkContext
    model = context.broadcast(languages or fitted_languages(documents, texts))  # of fixed size, like the counts
    counts = context.broadcast(answer_counts(texts))
    told = texts.where("plain is not null").select("qa_id", F.col("plain").alias("defect"))
    judged = texts.where("plain is null").select("qa_id", _prose(F.col("q")).alias("q"), "a", "prose", "refuses").mapInArrow(_judge(model, counts), "qa_id string, defect string")
    return told.unionByName(judged)
