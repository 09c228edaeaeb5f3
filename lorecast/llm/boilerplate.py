"""The main body of pages: a line classifier gives costs, a minimum cut over the page's lines draws the border.

Each line of a page is a node. What the classifier takes it for becomes its capacities to the two terminals; lines next to
each other, lines of one list, of one code block or between one pair of tags, and a list with the line that leads to it, are
joined by edges. The minimum cut labels the lines. Nodes whose own cost outweighs all their edges are decided first, which
changes no optimum; max-flow decides the rest.

The classifier learns from pages of documents whose text is at hand: a line found in the text, in order, is main body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecast.functions.keys import key
from lorecast.llm.canonical import canonicalizer
from lorecast.llm.sampling import sampled

#: The classifier is fitted on at most so many pages of at most so many documents of at most so many signs.
SAMPLE_DOCS, SAMPLE_PAGES, SAMPLE_SIGNS = 600, 4_800, 50_000
HASHES = 1 << 18
#: What the place of a line counts against what the line itself says; its neighbours also speak through the edges.
PLACE = 0.4

_BLANK = re.compile(r"^[\s­͏᠎​-‏⁠-⁤︀-️﻿ㅤ]*$")
_MASK = re.compile(r"\d+(?:[.,:/\-]\d+)*|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b\w+_\w+")
_TOKEN = re.compile(r"[一-鿿]|[^\W_]+|[^\w\s]")
_HAN2 = re.compile(r"(?=([一-鿿]{2}))")
_MARKER = re.compile(r"\s*(?:([-*•+·]|\d+[.)])\s|(#{1,6})\s|(\|)|(>)\s)")
_TAG = re.compile(r"\s*<(/?)([a-zA-Z][\w-]*)[^<>]*>\s*$")
_FENCE = re.compile(r"\s*(?:```|~~~)")


@lru_cache(50_000)
def _masked(line: str) -> str:
    return _MASK.sub(lambda m: "0" if m[0][0].isdigit() else "I", line)


def _hash(text: str) -> int:
    return crc32(text.encode()) & (HASHES - 1)


class Page:
    """The non-blank lines of a page: number, text, masked text, and what shapes the graph."""

    def __init__(self, content: str, form: str | None = None):
        self.numbers: list[int] = []
        self.lines: list[str] = []
        self.gap: list[bool] = []  # a blank line stands before
        self.block: list[int] = []  # code block or tag pair, -1 for none
        self.marker: list[str] = []
        gap, fence, blocks, stack = False, -1, 0, []
        for n, line in enumerate((content if form is None else form).split("\n"), 1):
            bare = line.strip()
            if not bare or not bare[0].isascii() and _BLANK.match(bare):
                gap = True
                continue
            inside, sign = fence, bare[0]
            if sign in "`~" and _FENCE.match(bare):
                if fence < 0:
                    blocks += 1
                    fence = inside = blocks
                else:
                    fence = -1
            elif fence < 0 and sign == "<" and (tag := _TAG.match(bare)):
                if not tag[1]:
                    blocks += 1
                    stack.append((tag[2].lower(), blocks))
                    inside = blocks
                elif stack and stack[-1][0] == tag[2].lower():
                    inside = stack.pop()[1]
            elif fence < 0 and stack:
                inside = stack[-1][1]
            m = _MARKER.match(bare) if sign in "-*•+·#|>0123456789" and inside < 0 else None
            self.numbers.append(n)
            self.lines.append(bare)
            self.gap.append(gap)
            self.block.append(inside)
            self.marker.append(next((x for x in m.groups() if x), "")[:1] if m else "")
            gap = False
        self.lead: list[int] = []  # the line with a colon that leads to the list or block, -1 for none
        for i in range(len(self.lines)):
            lead = -1
            if i and (self.marker[i] not in ("", "#") or self.block[i] >= 0):
                same = self.marker[i] == self.marker[i - 1] if self.block[i] < 0 else self.block[i] == self.block[i - 1]
                lead = self.lead[-1] if same else i - 1 if self.lines[i - 1][-1] in ":：" else -1
            self.lead.append(lead)

    def words(self, i: int) -> list[str]:
        """What the classifier sees of line ``i`` itself: its words and build, never the line as a whole."""
        line = self.lines[i]
        masked = _masked(line)
        tokens = _TOKEN.findall(masked.lower())
        out = tokens + [m[1] for m in _HAN2.finditer(masked)]
        last = line[-1:]
        out += [
            "F=" + " ".join(tokens[:2]), "E=" + " ".join(tokens[-2:]), f"m={self.marker[i]}", f"n={min(len(tokens), 12)}", f"c={min(len(line) // 12, 8)}",
            "q=" + last if not last.isalnum() else "q=w", f"t={'`' in line}{'I' in masked}", f"b={line.count('`') % 2}{self.block[i] >= 0}", f"u={bool(re.search(r'https?:|www|[a-z]+/[a-zA-Z_]|](/)', line))}",
        ]
        return out

    def around(self, i: int, n: int) -> list[str]:
        """What it sees of the place of line ``i`` of ``n``."""
        return [f"top={min(i, 5)}", f"end={min(n - 1 - i, 5)}", f"g={self.gap[i]}{i + 1 < n and self.gap[i + 1]}", f"l={self.lead[i] >= 0}{i + 1 < n and self.lead[i + 1] == i}", f"Pm={self.marker[i - 1] if i else '^'}", f"Nm={self.marker[i + 1] if i + 1 < n else '$'}"]

    def edges(self, strength: tuple[float, ...]) -> list[tuple[int, int, float]]:
        """(i, j, weight): neighbours, with and without a blank line between, of one list, of one block, one line apart, and a
        list or block with the line that leads to it by a colon."""
        near, far, listed, inside, apart, led = strength
        out = []
        first: dict[int, int] = {}
        for i in range(len(self.lines)):
            if i:
                w = far if self.gap[i] else near
                if self.marker[i] and self.marker[i] == self.marker[i - 1] and self.marker[i] != "#":
                    w += listed
                if self.block[i] >= 0 and self.block[i] == self.block[i - 1]:
                    w += inside
                out.append((i - 1, i, w))
                if self.lead[i] == i - 1:
                    out.append((i - 1, i, led))
                if i > 1 and not self.gap[i] and not self.gap[i - 1]:
                    out.append((i - 2, i, apart))
            if self.block[i] >= 0:
                k = first.setdefault(self.block[i], i)
                if i - k > 1:
                    out.append((k, i, inside))
        return out


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels that cost least: ``unary[i]`` is what it costs more to leave i unmarked than to mark it (below 0: less),
    an edge costs its weight if its ends differ. Ties leave a line unmarked."""
    n = len(unary)
    cost, links = list(unary), [[] for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            links[i].append((j, w))
            links[j].append((i, w))
    label: list[bool | None] = [None] * n
    open_w = [sum(w for _, w in ls) for ls in links]
    todo = list(range(n))
    while todo:  # persistency: a cost that all open edges together can't turn decides the node in every optimum
        i = todo.pop()
        if label[i] is None and (abs(cost[i]) > open_w[i] or not open_w[i]):
            label[i] = cost[i] > 0
            for j, w in links[i]:
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    open_w[j] -= w
                    if open_w[j] < 1e-12:
                        open_w[j] = 0.0
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, marked in zip(rest, _max_flow([cost[i] for i in rest], [(a, b, w) for a, b, w in _among(rest, links)])):
            label[i] = marked
    return label


def _among(rest: list[int], links: list[list[tuple[int, float]]]) -> list[tuple[int, int, float]]:
    at = {i: k for k, i in enumerate(rest)}
    return [(at[i], at[j], w) for i in rest for j, w in links[i] if i < j and j in at]


def _max_flow(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm from the source (marked) to the sink; marked are the nodes the source still reaches."""
    n = len(cost)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(cost):
        if c > 0:
            add(s, i, c, 0.0)
        elif c < 0:
            add(i, t, -c, 0.0)
    for i, j, w in edges:
        add(i, j, w, w)
    while True:
        depth = [-1] * (n + 2)
        depth[s] = 0
        queue = [s]
        for a in queue:
            for e in out[a]:
                if cap[e] > 1e-9 and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return [depth[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, a = [], s
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if cap[e] > 1e-9 and depth[to[e]] == depth[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


class LineClassifier:
    """Logistic regression on hashed words of a line and its place; scores are log odds of not being main body."""

    #: Strengths of edges tried on held-out pages.
    TRIED = ((0.05, 0.02, 0.1, 0.3, 0.02, 0.3), (0.15, 0.05, 0.4, 1.0, 0.05, 1.0), (0.15, 0.05, 1.5, 2.0, 0.05, 3.0), (0.15, 0.05, 4.0, 3.0, 0.05, 8.0), (0.3, 0.1, 0.8, 2.0, 0.1, 2.0), (0.3, 0.1, 2.5, 4.0, 0.1, 6.0), (0.6, 0.2, 1.5, 3.0, 0.2, 4.0), (1.0, 0.3, 2.0, 4.0, 0.3, 6.0))

    def __init__(self, pages: list[Page], labels: list[list[int]], rounds: int = 120, seed: int = 3):
        fit = np.random.default_rng(seed).random(len(pages)) < 0.8 if len(pages) > 20 else np.ones(len(pages), bool)
        self.weights, self.bias = np.zeros(HASHES, np.float32), 0.0
        taught = [p for p, f in zip(pages, fit) if f]
        told = [y for y, f in zip(labels, fit) if f]
        clean = list(told)
        for part in (0, 1):  # a document's text may differ from its page: labels that the other half contradicts teach nothing
            self._fit(taught[1 - part :: 2], told[1 - part :: 2], rounds)
            for i in range(part, len(taught), 2):
                clean[i] = [-1 if v >= 0 and (x > 0) != v else v for v, x in zip(told[i], self.scores(taught[i], {}))]
        self._fit(taught, clean, rounds)
        self.strength, self.held_out, self.turned = self.TRIED[1], None, 0.0
        held = [(p, y) for p, y, f in zip(pages, labels, fit) if not f]
        if held:
            best = []
            scored = [(p, self.scores(p, {}), y) for p, y in held]
            for strength in self.TRIED:
                hit = got = want = 0
                for p, scores, y in scored:
                    for marked, true in zip(minimum_cut(scores, p.edges(strength)), y):
                        if true >= 0:
                            hit, got, want = hit + (marked and true), got + marked, want + true
                best.append((2 * hit / max(1, got + want), strength))
            self.held_out, self.strength = max(best, key=lambda b: b[0])
            cut = [(m, x > 0) for p, scores, _ in scored for m, x in zip(minimum_cut(scores, p.edges(self.strength)), scores)]
            self.turned = sum(m != alone for m, alone in cut) / max(1, len(cut))  # labels that the cut changes against the classifier alone

    def _fit(self, pages: list[Page], labels: list[list[int]], rounds: int) -> None:
        idx, row, val, y = [], [], [], []
        for p, ys in zip(pages, labels):
            n = len(p.lines)
            for i, v in enumerate(ys):
                if v >= 0:
                    for hashes, weight in (({_hash(w) for w in p.words(i)}, 1.0), ({_hash(w) for w in p.around(i, n)}, PLACE)):
                        idx.extend(hashes)
                        row.extend([len(y)] * len(hashes))
                        val.extend([weight] * len(hashes))
                    y.append(v)
        if not y:
            return
        self.__dict__.pop("_listed", None)
        at, r, x, target = np.array(idx), np.array(row), np.array(val), np.array(y, float)
        w, acc, b, bacc = np.zeros(HASHES), np.full(HASHES, 1e-4), 0.0, 1e-4
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(np.bincount(r, w[at] * x, len(target)) + b)))
            g = p - target
            grad = np.bincount(at, g[r] * x, HASHES) + 0.05 * w
            acc += grad**2
            w -= 0.3 * grad / np.sqrt(acc)
            bacc += g.sum() ** 2
            b -= 0.3 * g.sum() / np.sqrt(bacc)
        self.weights, self.bias = w.astype(np.float32), float(b)

    @property
    def listed(self) -> list[float]:
        """The weights as a list, in which single ones are found faster; made once in each process."""
        if "_listed" not in self.__dict__:
            self._listed = self.weights.tolist()
        return self._listed

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_listed"}

    def scores(self, page: Page, seen: dict[str, float]) -> list[float]:
        """The log odds of each line; ``seen`` keeps the part that words alone give, for lines that come again."""
        n, w, out = len(page.lines), self.listed, []
        for i, line in enumerate(page.lines):
            known = (line, page.block[i] >= 0)
            own = seen.get(known)
            if own is None:
                own = sum(map(w.__getitem__, {_hash(x) for x in page.words(i)}))
                if len(line) < 120:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[known] = own
            out.append(own + PLACE * sum(map(w.__getitem__, {_hash(x) for x in page.around(i, n)})) + self.bias)
        return out

    def marked(self, content: str | None, form: str | None, seen: dict) -> list[int]:
        """The numbers of the non-blank lines that are not part of the main body."""
        if not content:
            return []
        page = Page(content, form)
        return [n for n, m in zip(page.numbers, minimum_cut(self.scores(page, seen), page.edges(self.strength))) if m]


def aligned(page: Page, text: str) -> list[int]:
    """0 for lines that the document's text has in the same order, 1 for the rest; -1 where nothing of the page is in the text."""
    mine, theirs = page.lines, [x.strip() for x in text.split("\n") if x.strip()]
    out = [1] * len(mine)
    for a, _, size in SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks():
        out[a : a + size] = [0] * size
    return out if 0 in out else [-1] * len(mine)


def _fields(chunks: DataFrame) -> DataFrame:
    return chunks.select(key("id").alias("chunk_id"), key("doc_id").alias("doc_id"), "content", F.get_json_object("metadata_json", "$.source_url").alias("url"), "metadata_json")


def web_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, content) of chunks from web imports: by their own metadata, or where that says nothing by their document."""
    rows = _fields(chunks).where(F.col("content").isNotNull() & F.col("chunk_id").isNotNull())
    known = rows.where(F.col("url").isNotNull())
    unknown = rows.where(F.col("metadata_json").isNull())
    web = documents.where(F.lower("source_type") == "url").select(key("id").alias("doc_id")).distinct()
    return known.unionByName(unknown.join(web, "doc_id", "left_semi").select(*known.columns)).select("chunk_id", "doc_id", "content")


def fitted(chunks: DataFrame, documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineClassifier:
    """A classifier from the pages of the ``sample_docs`` web documents with the least hash of their id (of up to ``SAMPLE_SIGNS``
    signs, and of their pages up to ``SAMPLE_PAGES``): bounds on what is fitted, not on what is labelled.

    Web documents without a page that shows any of their text are an error.
    """
    docs = documents.where((F.lower("source_type") == "url") & F.length("text").between(1, SAMPLE_SIGNS)).select(key("id").alias("doc_id"), "text").where("doc_id is not null")
    texts = {r.doc_id: r.text for r in sampled(docs, "doc_id", sample_docs, "page", documents.count())}
    of_sample = chunks.where(key("doc_id").isin(list(texts)))  # a list of bounded length, no join
    pages = sampled(web_pages(of_sample, documents).where(F.length("content") <= SAMPLE_SIGNS), "chunk_id", SAMPLE_PAGES, "page", 0) if texts else []
    form = canonicalizer()
    made = [(Page(form(c)), form(t)) for c, t in sorted({(r.content, texts[r.doc_id]) for r in pages})]
    labels = [aligned(p, t) for p, t in made]
    if made and not any(0 in y for y in labels):
        raise ValueError("no page of the sample shows the text of its document, so nothing teaches what a main body is")
    return LineClassifier([p for p, _ in made], labels)


def _mark(model, main: bool):
    form = canonicalizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LineClassifier = model.value
        seen: dict = {}
        for batch in batches:
            ids, contents = batch.column("chunk_id"), batch.column("content").to_pylist()
            found = [m.marked(c, form(c), seen) for c in contents]
            if main:
                yield pa.RecordBatch.from_arrays([ids, pa.array([_without(c, f) for c, f in zip(contents, found)], pa.string())], names=["chunk_id", "content"])
            else:
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([n for f in found for n in f], pa.int32())], names=["chunk_id", "line_no"])

    return run


def _without(content: str, numbers: list[int]) -> str:
    gone = set(numbers)
    lines = [line for n, line in enumerate(content.split("\n"), 1) if n not in gone]
    return re.sub(r"\n(?:[ \t\r]*\n){2,}", "\n\n", "\n".join(lines)).strip() if gone else content


def marked_lines(chunks: DataFrame, documents: DataFrame, model: LineClassifier | None = None) -> DataFrame:
    """(chunk_id, line_no): each non-blank line of a web page that is not main body, counted from 1, blank lines included.

    Null and empty contents and null ids give no rows; rows written several times count once; a page of any length is
    labelled whole. Chunks that are no web pages have main body only.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model or fitted(chunks, documents))  # weights of fixed size
    pages = web_pages(chunks, documents).select("chunk_id", "content")
    return pages.mapInArrow(_mark(shared, False), "chunk_id string, line_no int").distinct()


def main_bodies(chunks: DataFrame, documents: DataFrame, model: LineClassifier | None = None) -> DataFrame:
    """(chunk_id, content): each web page with its main body only; an empty text where it has none. Repeated rows stay."""
    shared = chunks.sparkSession.sparkContext.broadcast(model or fitted(chunks, documents))
    pages = web_pages(chunks, documents).select("chunk_id", "content")
    return pages.mapInArrow(_mark(shared, True), "chunk_id string, content string")
