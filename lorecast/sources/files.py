"""Files and pages in, tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# MIME types and languages by extension, and extensions of files without text.
MIME = {".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".txt": "text/plain", ".py": "text/x-python", ".js": "text/javascript", ".java": "text/x-java", ".json": "application/json", ".csv": "text/csv"}
LANGUAGE = {".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".sql": "sql"}
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".gz", ".tar", ".exe", ".dll", ".so", ".pyc", ".class", ".jar")
MOST_BYTES = 10 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def _looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def mime_type(path: Column) -> Column:
    return _looked_up(extension(path), MIME, "text/plain")


def language(path: Column) -> Column:
    return _looked_up(extension(path), LANGUAGE, "text")


def read_tree(spark: SparkSession, root: str, prefixes: Sequence[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, text, file_hash, mime_type, language) of the text files below ``root``, or of those under ``prefixes`` of it.

    Files with a binary extension or above ``most_bytes`` are left out before they are read; bytes that are no UTF-8 come out as
    replacement signs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")
    kept = files.where(F.col("length") <= most_bytes).withColumn("path", rel).where(~extension(F.col("path")).isin(*BINARY))
    if prefixes:
        under = F.lit(False)
        for p in prefixes:
            under = under | F.col("path").startswith(p)
        kept = kept.where(under)
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("file_hash"), mime_type(F.col("path")).alias("mime_type"), language(F.col("path")).alias("language"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def headed(text: Column, path: Column) -> Column:
    """Source code with a header that names its language and file."""
    return F.concat(F.lit("# Language: "), language(path), F.lit("\n# File: "), path, F.lit("\n\n"), text)


def page_title(html: Column, suffixes: Sequence[str] = ()) -> Column:
    """The title of a page, else its first heading, without tags and without what a site puts behind it; null if there is neither."""
    found = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")))
    title = F.trim(F.regexp_replace(F.regexp_replace(found, r"<[^>]+>", ""), r"\s+", " "))
    for suffix in suffixes:
        title = F.when(title.endswith(suffix), F.trim(F.left(title, F.length(title) - len(suffix)))).otherwise(title)
    return title


def page_links(html: Column) -> Column:
    """The distinct targets of links, in order, without fragments."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+)"""), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (kb_id, content, ...) whose bytes their base does not hold yet, each content once, with ``doc_hash``."""
    hashed = uploads.withColumn("doc_hash", F.sha2("content", 256)).dropDuplicates(["kb_id", "doc_hash"])
    return hashed.join(known.select("kb_id", "doc_hash").distinct(), ["kb_id", "doc_hash"], "left_anti")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(question, doc, chunk_index, reference_answer, difficulty) of JSON annotation files, a row per chunk they name."""
    schema = "question string, doc string, chunk_indices array<int>, reference_answer string, difficulty string"
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("chunk_index", F.explode_outer("chunk_indices")).drop("chunk_indices")
