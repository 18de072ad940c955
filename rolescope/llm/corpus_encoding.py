"""Encoding of the corpus with a public byte-level tokenizer (problem 8)."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this many characters are split before encoding.
SPLIT_CHARS = 1 << 16
# Fixed value: the tokenizer's own pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A letter or digit before a blank or line end, or between a letter and a digit: no piece of PATTERN spans it,
#: and a piece that starts behind it does not depend on what stands before.
SAFE = regex.compile(r"[\p{L}\p{N}](?=[ \n])|\p{L}(?=\p{N})|\p{N}(?=\p{L})")


#: A byte that is no part of a character, as decoding marks it.
_STRAY = re.compile("([\udc80-\udcff])")


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """The file at ``path`` of the driver's machine, sent to every executor once; called in a task it gives the path there."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a local rank file; one per worker process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters whose encodings concatenate to that of ``text``."""
    start = 0
    while len(text) - start > size:
        at = SAFE.search(text, start + size - 1)
        if at is None:
            break
        yield text[start : at.end()]
        start = at.end()
    yield text[start:]


def _mixed_bytes(enc, raw: bytes, size: int) -> list[np.ndarray]:
    """Ids of bytes that are no UTF-8 as a whole: those of each stretch that is, and of each other byte its own."""
    out = []
    for piece in _STRAY.split(raw.decode("utf-8", "surrogateescape")):
        if _STRAY.fullmatch(piece):
            out.append(np.array([enc.encode_single_token(piece.encode("utf-8", "surrogateescape"))], np.int32))
        elif piece:
            out += encode_bytes(enc, piece.encode(), size)
    return out


def encode_bytes(enc, raw: bytes | None, size: int = SPLIT_CHARS) -> list[np.ndarray]:
    """Token ids of one text, as the arrays of its pieces.

    Null and empty texts have none. Bytes that are not UTF-8 are encoded one by one.
    """
    if not raw:
        return []
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return _mixed_bytes(enc, raw, size)
    pieces = (text,) if len(text) <= size else safe_pieces(text, size)
    return [enc.encode_to_numpy(piece, disallowed_special=()).astype(np.int32) for piece in pieces]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "ids",
           ranks_path: str = f"{TOKENIZER_DIR}/{RANKS}") -> DataFrame:
    """``id_col`` and the token ids of ``text_col``, one row for each input row.

    The ids of a null or an empty text are an empty list, a blank text has the ids of its blanks. No special token is
    ever made: its spelling in a text is ordinary text. Narrow: no shuffle, and only two columns reach the Python
    workers; ids leave as one flat Arrow array per batch.
    """
    ranks = shipped(df.sparkSession, ranks_path)
    source = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("_raw"))
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks())
        for batch in batches:
            arrays, lengths = [], [0]
            for raw in batch.column(1):
                own = encode_bytes(enc, raw.as_py())
                arrays += own
                lengths.append(sum(map(len, own)))
            flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
            offsets = pa.array(np.cumsum(lengths), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, `{out}` array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", out: str = "raw",
           ranks_path: str = f"{TOKENIZER_DIR}/{RANKS}") -> DataFrame:
    """Raw bytes of id lists: exact even where a list ends inside a character. Null ids give null bytes."""
    ranks = shipped(df.sparkSession, ranks_path)
    source = df.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("_ids"))
    id_type = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks())
        for batch in batches:
            raw = [None if ids is None else enc.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, `{out}` binary")


def token_profile(encoded: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, characters and tokens of each source and language, over all documents."""
    counts = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    joined = documents.select("doc_id", "source", "lang", F.length("text").alias("n")).join(counts, "doc_id")
    return joined.groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.sum("n_tokens").alias("tokens")
    )


def round_trip(documents: DataFrame, ranks_path: str = f"{TOKENIZER_DIR}/{RANKS}") -> DataFrame:
    """One row: documents, and how many decode to other bytes than their text (none, unless something is wrong)."""
    back = decode(encode(documents, ranks_path=ranks_path), ranks_path=ranks_path)
    text = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return text.join(back, "doc_id").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum((F.col("raw") != F.col("text")).cast("long")), F.lit(0)).alias("changed")
    )
