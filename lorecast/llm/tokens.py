"""Encoding of a corpus with a public byte-level BPE vocabulary, each distinct word once.

Texts are cut into words (pre-tokens) and written as blocks: the distinct words of some megabytes of text, and for each
document the places of its words in that list. The words of all blocks are made distinct by a shuffle, each is encoded once,
the ids are joined back to the blocks that hold the word, and each block puts its documents together by position.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorecast.operators.skew import HOT_ROWS, salted_join
from lorecast.session import write_shared

#: Where the vocabulary files lie; another place is given by the parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block ends with the document that brings it to so many characters.
BLOCK_CHARS = 2_000_000


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file: a line per token, its bytes in base64 and its id. Its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@lru_cache(2)
def _encoder(data: bytes):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=_ranks(data), special_tokens={})


def _blocks(schema: pa.Schema, block_chars: int):
    """Cuts record batches of (carried columns..., text) into block rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of = regex.compile(PATTERN).findall
        for batch in batches:
            texts, start, codes, counts, size = batch.column(batch.num_columns - 1), 0, [], [], 0
            places: defaultdict[str, int] = defaultdict()
            places.default_factory = places.__len__
            for i, text in enumerate(texts):
                text = text.as_py()
                words = words_of(text) if text else ()
                codes.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                counts.append(len(words))
                size += len(text or "")
                if size >= block_chars or i + 1 == len(texts):
                    flat = np.concatenate(codes)
                    small = flat.astype(np.uint16) if len(places) <= 1 << 16 else flat
                    carried = [pa.ListArray.from_arrays(pa.array([0, i + 1 - start], pa.int32()), c.slice(start, i + 1 - start)) for c in batch.columns[:-1]]
                    row = [
                        pa.array([uuid.uuid4().hex]), *carried, pa.array([counts], pa.list_(pa.int32())),
                        pa.array([zlib.compress(small.tobytes(), 1)], pa.binary()), pa.array([small.itemsize], pa.int32()), pa.array([list(places)], pa.list_(pa.string())),
                    ]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(row, schema)], schema=schema)
                    start, codes, counts, size = i + 1, [], [], 0
                    places.clear()

    return run


def word_blocks(df: DataFrame, carry: Sequence[str], text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, the carried columns as arrays, counts, codes, width, words), written to the shared folder."""
    rows = df.select(*carry, F.col(text_col).alias("_text"))
    fields = [T.StructField("block", T.StringType())]
    fields += [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in carry]
    fields += [T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    return write_shared(rows.mapInArrow(_blocks(arrow, block_chars), schema), "words")


def _assemble(carry: Sequence[str], value: str, schema: pa.Schema):
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        """The documents of one block from the ids (or their number) of its words."""
        if not block.num_rows:
            return schema.empty_table()
        row = block.slice(0, 1).combine_chunks()
        kind = np.uint16 if row["width"][0].as_py() == 2 else np.uint32
        codes = np.frombuffer(zlib.decompress(row["codes"][0].as_py()), kind)
        counts = row["counts"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        words = words.sort_by("place").combine_chunks()
        ends = np.cumsum(counts)
        if value == "ids":
            ids = words["value"].chunk(0) if words.num_rows else pa.array([], pa.list_(pa.int32()))
            lens = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lens) - lens
            per = lens[codes]
            upto = np.concatenate([[0], np.cumsum(per)])
            take = np.repeat(starts[codes] - upto[:-1], per) + np.arange(upto[-1])
            offsets = upto[np.concatenate([[0], ends])]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[take].astype(np.int32)))
        else:
            lens = words["value"].to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(lens[codes])])
            made = pa.array(np.diff(upto[np.concatenate([[0], ends])]), pa.int64())
        carried = [row[c].chunk(0).flatten() for c in carry]
        return pa.Table.from_arrays([a.cast(f.type) for a, f in zip([*carried, made], schema)], schema=schema)

    return run


def _encoded(df: DataFrame, carry: Sequence[str], text_col: str, name: str, count: bool, path: str, block_chars: int, hot_rows: int) -> DataFrame:
    taken = {*carry, name}
    if len(taken) <= len(carry):
        raise ValueError("a carried column is named like the result")
    inner = [f"c{i}" for i in range(len(carry))]
    blocks = word_blocks(df.select(*(F.col(c).alias(i) for c, i in zip(carry, inner)), F.col(text_col).alias("t")), inner, "t", block_chars)
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # of the vocabulary's size

    @F.arrow_udf("array<int>")
    def encode(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(ranks.value)
        for w in words:
            yield pa.array(enc.encode_ordinary_batch(w.to_pylist(), num_threads=1), pa.list_(pa.int32()))

    entries = blocks.select(F.col("block").alias("in_block"), F.posexplode("words").alias("place", "word"))
    once = entries.select("word").distinct().withColumn("value", encode("word"))
    if count:
        once = once.withColumn("value", F.size("value"))
    found = salted_join(entries, once, ["word"], "inner", F.col("in_block"), hot_rows).select("in_block", "place", "value")
    result = T.LongType() if count else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in carry), T.StructField(name, result)])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    both = blocks.drop("words").groupBy("block").cogroup(found.groupBy("in_block"))
    return both.applyInArrow(_assemble(inner, "count" if count else "ids", arrow), schema)


def token_ids(df: DataFrame, carry: Sequence[str], text_col: str, name: str = "ids", path: str = VOCABULARY, block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The columns ``carry`` of ``df`` and the token ids of its text: one row per row of ``df``, repeated rows included.

    Null and empty texts give an empty list; text that looks like a special token is plain text; a text of any length is
    encoded whole. The carried columns may hold nulls and bear any names but ``name``.
    """
    return _encoded(df, carry, text_col, name, False, path, block_chars, hot_rows)


def token_counts(df: DataFrame, carry: Sequence[str], text_col: str, name: str = "n_tokens", path: str = VOCABULARY, block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``token_ids``, but with the number of tokens; 0 for null and empty texts."""
    return _encoded(df, carry, text_col, name, True, path, block_chars, hot_rows)


def _texts(ids: pa.Array, table: pa.Array) -> pa.Array:
    """The texts of lists of ids: the ids joined to the token-byte table by position, the bytes cut at the lists' ends."""
    flat = ids.flatten()
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table) - 1)), False)
    taken = table.take(pc.if_else(known, flat, pa.scalar(len(table) - 1, flat.type)))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][np.concatenate([[0], ends])]
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(places)), taken.buffers()[2]])
    try:
        return whole.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())


def decoded(df: DataFrame, id_col: str, ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text): ``ids`` as text again, without a shuffle; empty and null lists give an empty text.

    The token-byte table is broadcast, as it has the vocabulary's size, and joined to the ids of a batch by position. Ids that
    it lacks give nothing; bytes that are no UTF-8 come out as replacement signs.
    """
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_id = {i: b for b, i in _ranks(ranks.value).items()}
        table = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 2)], pa.large_binary())  # the last stands for unknown ids
        for ids in batches:
            yield _texts(ids, table)

    return df.select(id_col, text(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).alias("text"))
