"""Chunkers: one document in, its chunks out, by the kind of text. A document is one row, so tasks never hold more than one.

Lines or paragraphs are measured once; where a new part must begin is known from flags, and a part that is too long is cut
where the running sum of its sizes passes the limit, found by search in the sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Sizes in estimated tokens (a quarter of the signs) and signs, and the file kinds that hold code.
SECTION_TOKENS, PROSE_TOKENS, OVERLAP_SIGNS, LEAST_SIGNS = 1500, 1000, 200, 30
CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift",
    ".kt", ".scala", ".r", ".m", ".sh", ".bash", ".sql", ".yml", ".yaml", ".toml", ".ini", ".cfg",
)
# How functions and classes begin, by language; other languages are read as Python.
FUNCTIONS = {
    "python": r"\s*(?:async\s+)?def\s+\w+\s*\(|\s*@\w+",
    "javascript": r"function\s+\w+|\w+\s*=\s*(?:async\s+)?(?:function|\(.*\)\s*=>)",
    "typescript": r"function\s+\w+|\w+\s*=\s*(?:async\s+)?(?:function|\(.*\)\s*=>)",
    "java": r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+\w+\s*\([^)]*\)\s*\{",
    "go": r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+\s*\(",
    "rust": r"fn\s+\w+",
    "c": r"\s*(?:static\s+|inline\s+|extern\s+)*[\w*]+\s+\w+\s*\([^;]*\)\s*\{",
    "cpp": r"\s*(?:static\s+|inline\s+|virtual\s+|explicit\s+|friend\s+)*[\w*:~<>]+\s+\w+\s*\([^;]*\)\s*(?:const\s*)?\{",
    "csharp": r"\s*(?:public|private|protected|internal|static|virtual|override|async)\s+[\w<>\[\]]+\s+\w+\s*\([^;]*\)\s*\{",
}
CLASSES = {
    "python": r"\s*class\s+\w+",
    "javascript": r"class\s+\w+",
    "typescript": r"class\s+\w+",
    "java": r"(?:public\s+)?class\s+\w+",
    "go": r"type\s+\w+\s+struct\s*\{",
    "rust": r"struct\s+\w+|impl\s+\w+",
    "c": r"\s*(?:typedef\s+)?struct\s+\w+",
    "cpp": r"\s*class\s+\w+|\s*struct\s+\w+",
    "csharp": r"\s*(?:public|internal|abstract\s+)?(?:partial\s+)?class\s+\w+",
}
FUNCTION, CLASS = 1, 2


def chunk_kind(extension: Column, mime: Column, language: Column) -> Column:
    """code, markdown or prose, by extension, MIME type and language; nulls count as empty."""
    ext = F.lower(F.coalesce(extension, F.lit("")))
    code = ext.isin(*CODE_EXTENSIONS) | F.coalesce(language, F.lit("")).contains("code")
    marked = F.coalesce(mime, F.lit("")).contains("markdown") | ext.isin(".md", ".html", ".htm")
    return F.when(code, "code").when(marked, "markdown").otherwise("prose")


def line_flags(text: Column, language: Column) -> Column:
    """For each line of ``text`` whether a function or a class begins there, as its language writes them."""
    spoken = F.lower(F.coalesce(language, F.lit("python")))
    pattern = lambda of: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for name, p in of.items() for x in (name, f"(?U)^(?:{p})"))), spoken), F.lit(f"(?U)^(?:{of['python']})"))
    mark = lambda line: F.when(F.regexp_like(line, pattern(FUNCTIONS)), FUNCTION).when(F.regexp_like(line, pattern(CLASSES)), CLASS).otherwise(0)
    return F.transform(F.split(text, "\n", -1), mark)


def _fitting(sums: np.ndarray, start: int, most: int) -> int:
    """The first place from ``start`` on at which what has run up since then is more than ``most``."""
    return int(np.searchsorted(sums[start + 1 :], sums[start] + most, "right")) + start


def markdown_chunks(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, content, first line, line after): fenced blocks by themselves, a new chunk at each heading, long sections cut
    where they exceed the limit; what stands before a fence is text, and what is too short is left out."""
    lines = text.split("\n")
    fences = np.array([line.lstrip().startswith("```") for line in lines])
    opened = np.cumsum(fences) % 2 == 1  # from an opening fence up to the line before the closing one
    heads = np.array([line.startswith("#") for line in lines]) & ~opened & ~fences
    opens, closes = fences & opened, fences & ~opened
    edges = sorted({0, *np.flatnonzero(opens | heads), *(np.flatnonzero(closes) + 1)} - {len(lines)})
    sums = np.cumsum([0, *(len(line) + 1 for line in lines)])
    for a, b in zip(edges, [*edges[1:], len(lines)]):
        name = lines[a].strip()[3:].strip() if opens[a] else ""
        kind = (f"code_block_{name}" if name else "code_block") if opens[a] else "text_heading" if heads[a] else "text"
        fenced = bool(opens[a])
        free = b - 1 if fenced and closes[b - 1] else b  # a closing fence always fits
        while a < b:
            full = _fitting(sums[: free + 1], a, 4 * SECTION_TOKENS + 3)  # the line that is too much still belongs to the piece
            end = full + 1 if full < free else b
            content = "\n".join(lines[a:end]).strip()
            if len(content) >= LEAST_SIGNS:
                yield "text" if full >= free and b < len(lines) and opens[b] and not fenced else kind, content, a, end
            a = end


def code_chunks(text: str, flags: Sequence[int]) -> Iterator[tuple[str, str, int, int]]:
    """(type, content, first line, line after): a new chunk where a function or class begins (``flags``), and after too many
    lines. A line that is first in its chunk, in the file or after a cut, changes no type; the file begins as text."""
    lines = text.split("\n")
    sums = np.cumsum([0, *(len(line) + 1 for line in lines)])
    starts = np.flatnonzero(np.asarray(flags, int))
    kind, a = "text", 0
    while a < len(lines):
        cut = min(_fitting(sums, a, 4 * SECTION_TOKENS + 4), len(lines))  # the line that is too much still belongs to the chunk
        after = np.searchsorted(starts, a, "right")
        turn = int(starts[after]) if after < len(starts) else len(lines)
        end = min(turn, cut + 1, len(lines))
        content = "\n".join(lines[a:end])
        if content.strip():
            yield kind, content, a, end
        if end == turn < len(lines) and cut + 1 > turn:
            kind = "function" if flags[turn] == FUNCTION else "class"
        a = end


def _packed(parts: list[str], joint: str, held: str = "") -> Iterator[tuple[str, int]]:
    """``parts`` put together up to the size of a chunk, the first behind ``held``: (text, parts used so far)."""
    sums = np.cumsum([0, *(len(p) + len(joint) for p in parts)])
    most, a = 4 * PROSE_TOKENS + 3, 0
    while a < len(parts):
        end = a + 1
        if end < len(parts) and len(held) + len(parts[a]) + len(parts[end]) <= most:  # a joint is not counted with the part that comes
            held = held.lstrip()
            end = max(end + 1, _fitting(sums, a, most + 2 * len(joint) - len(held)))
        yield held + joint.join(parts[a:end]), end
        held, a = "", end


def prose_chunks(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(type, content, place, place after): paragraphs packed up to a size, each chunk after the first beginning with the end
    of the one before; a first paragraph that is too long by itself is cut at sentence ends."""
    parts = [p for p in (p.strip() for p in text.split("\n\n")) if p]
    place = 0
    if parts and len(parts[0]) > 4 * PROSE_TOKENS + 3:
        pieces = [piece for piece, _ in _packed(re.split(r"(?<=[.!?])\s+", parts[0]), " ")]
        for piece in pieces[:-1]:
            yield "text", piece, place, place + 1
            place += 1
        parts[0] = pieces[-1]
    held = ""
    while parts:
        content, used = next(_packed(parts, "\n\n", held))
        yield "text", content if used < len(parts) else content.strip(), place, place + 1
        held, parts, place = content[-OVERLAP_SIGNS:] if len(content) > OVERLAP_SIGNS else "", parts[used:], place + 1


def _cut(schema: pa.Schema, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            out: list[tuple] = []
            kinds, texts, flags = (batch.column(carried + i).to_pylist() for i in range(3))
            for i, (kind, text) in enumerate(zip(kinds, texts)):
                if text:
                    made = code_chunks(text, flags[i]) if kind == "code" else markdown_chunks(text) if kind == "markdown" else prose_chunks(text)
                    out.extend((n, *chunk) for n, chunk in enumerate(made))
                    of.extend([i] * (len(out) - len(of)))
            at = pa.array(of, pa.int64())
            columns = [batch.column(i).take(at) for i in range(carried)] + [pa.array([r[k] for r in out], schema.field(carried + k).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def chunked(docs: DataFrame, id_col: str, text_col: str, kind: Column, language: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc, the columns ``carry``, chunk_index, chunk_type, content, start_line, end_line, chunk_id, token_count, preview) of each document (id as string).

    ``kind`` says how a row is cut, ``language`` how its code is read (null: as Python). Null and empty texts have no chunks;
    ``start_line`` and ``end_line`` count lines from 0, the end exclusive, of prose they count chunks; chunk ids follow from
    document, place and content. A carried column may not be named like one of these.
    """
    spoken = language if language is not None else F.lit(None).cast("string")
    flags = F.when(kind == "code", line_flags(F.col(text_col), spoken))
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), *carry, kind.alias("_kind"), F.col(text_col).alias("_text"), flags.alias("_flags"))
    made = [("chunk_index", T.IntegerType()), ("chunk_type", T.StringType()), ("content", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType())]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in ("doc", *carry)), *(T.StructField(n, t) for n, t in made)])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    chunks = rows.mapInArrow(_cut(arrow, 1 + len(carry)), schema)
    return chunks.select(
        "*", F.sha2(F.concat_ws("\x1f", "doc", "chunk_index", "content"), 256).alias("chunk_id"), F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int").alias("token_count"), F.substring("content", 1, 200).alias("preview")
    )
