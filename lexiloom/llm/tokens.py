"""Encoding with a public byte-level tokenizer: whole corpora, long texts in overlapping chunks, token counts."""

from __future__ import annotations

import base64
import os
import threading
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every operator, this is its default.
TOKENIZER_DIR = os.environ.get("LEXILOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Characters in a chunk of a long text, and by how many a window reaches into the next chunk.
CHUNK, OVERLAP = 16_384, 1_024
#: Fixed value: the pre-token pattern that the vocabulary files document.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def rank_file(folder: str, name: str) -> bytes:
    return Path(folder, f"{name}.tiktoken").read_bytes()


_MADE: dict[int, object] = {}
_LOCK = threading.Lock()


def encoding(ranks: bytes):
    """The encoder of a rank file, made once in each Python worker."""
    import tiktoken

    key = hash(ranks)
    with _LOCK:
        if key not in _MADE:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            _MADE[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        return _MADE[key]


def _id_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType)


def _windows(ident: str, text: str, chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, whole in zip(batch[ident], batch[text]):
                for k in range(0, -(-len(whole) // chunk)):
                    window = whole[k * chunk : (k + 1) * chunk + overlap]
                    yield pd.DataFrame({ident: [key], "__k": [k], "__window": [window]})

    return run


def boundaries(window: str, low: int, high: int) -> list[int]:
    """Offsets in [low, high) at which a pre-token of window starts after one that ends in no white space.

    Only there do both parts, split apart, give the pre-tokens of the whole. Offsets within 8 of the window's end
    are left out, since its last pre-tokens may be cut.
    """
    import regex

    return [
        m.end()
        for m in regex.compile(PATTERN).finditer(window)
        if low <= m.end() < min(high, len(window) - 8) and not window[m.end() - 1].isspace()
    ]


def _marks(ident: str, chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            head, tail = [], []
            for k, window in zip(batch["__k"], batch["__window"]):
                at = k * chunk
                found = boundaries(window, 0, chunk + overlap)
                head.append([at + x for x in found if x < overlap])
                tail.append([at + x for x in found if x >= chunk])
            yield pd.DataFrame({ident: batch[ident], "__k": batch["__k"], "__head": head, "__tail": tail})

    return run


def pieces(df: DataFrame, ident: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Cut long texts into pieces (ident, piece, text) that can be encoded one by one.

    Overlapping windows are pre-tokenised in parallel. Two neighbours are stitched at the first boundary that both
    find in their overlap: from there on they agree, as the pattern looks at no earlier text. Where they don't
    resynchronise in the overlap, e.g. in a run of letters longer than it, the two chunks stay one piece.
    """
    schema = T.StructType([_id_field(df, ident), T.StructField("__k", T.IntegerType()), T.StructField("__window", T.StringType())])
    windows = df.select(ident, text).mapInPandas(_windows(ident, text, chunk, overlap), schema).repartition(F.col(ident), F.col("__k"))
    longs = T.ArrayType(T.LongType())
    marks = windows.mapInPandas(
        _marks(ident, chunk, overlap),
        T.StructType([schema[0], schema[1], T.StructField("__head", longs), T.StructField("__tail", longs)]),
    )
    w = Window.partitionBy(ident).orderBy("__k")
    common = F.array_intersect(F.lag("__tail").over(w), F.col("__head"))
    cuts = marks.select(ident, "__k", F.when(F.col("__k") == 0, F.lit(0).cast("long")).otherwise(F.get(common, F.lit(0))).alias("__cut"))
    w = Window.partitionBy(ident).orderBy("__k")
    cuts = cuts.select(
        ident,
        "__k",
        F.last("__cut", ignorenulls=True).over(w).alias("piece"),
        F.coalesce("__cut", F.col("__k").cast("long") * chunk).alias("__from"),
        F.coalesce(F.lead("__cut").over(w), (F.col("__k").cast("long") + 1) * chunk).alias("__to"),
    )
    at = F.col("__k").cast("long") * chunk
    parts = windows.join(cuts, [ident, "__k"]).select(
        ident, "piece", "__k", F.col("__window").substr((F.col("__from") - at + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int")).alias("__part")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__part"))), lambda x: x["__part"]), "")
    return parts.groupBy(ident, "piece").agg(joined.alias(text))


def _encode(ranks: bytes, text: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks).encode_ordinary
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = [encoder(x) if x else [] for x in texts]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if counts:
                made = pa.array(sizes)
            else:
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                made = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
            rest = [i for i in range(batch.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), made], names=[*(batch.schema.names[i] for i in rest), "ids"])

    return run


def _encoded(df: DataFrame, text: str, ranks: bytes, counts: bool) -> DataFrame:
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(f for f in df.schema if f.name != text), T.StructField("ids", kind)])
    return df.mapInArrow(_encode(ranks, df.columns.index(text), counts), schema)


def _split(df: DataFrame, text: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.length(text), F.lit(0))
    return df.where(size <= chunk + overlap), df.where(size > chunk + overlap)


def encode(
    df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(ident, ids): each text as token ids without special tokens; ident must be unique.

    A null text and an empty one both give the empty list. Strings of special tokens are ordinary text. Texts of up
    to a chunk are encoded where they are read, without a shuffle; longer ones by :func:`pieces`, in parallel.
    """
    ranks = rank_file(folder, tokenizer)
    short, long = _split(df.select(ident, text), text, chunk, overlap)
    parts = _encoded(pieces(long, ident, text, chunk, overlap), text, ranks, False)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]))
    return _encoded(short, text, ranks, False).unionByName(parts.groupBy(ident).agg(whole.alias("ids")))


def count_tokens(
    df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(ident, tokens): the number of ids that :func:`encode` gives, without building them."""
    ranks = rank_file(folder, tokenizer)
    short, long = _split(df.select(ident, text), text, chunk, overlap)
    parts = _encoded(pieces(long, ident, text, chunk, overlap), text, ranks, True)
    return _encoded(short, text, ranks, True).unionByName(parts.groupBy(ident).agg(F.sum("ids").alias("ids"))).withColumnRenamed("ids", "tokens")


def decode(df: DataFrame, ident: str, ids: str = "ids", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(ident, text): the concatenated raw bytes of the ids, read as UTF-8. A null list gives null."""
    ranks = rank_file(folder, tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoding(ranks)
        for batch in batches:
            texts = [None if x is None else encoder.decode_bytes(list(x)).decode("utf-8", "replace") for x in batch[ids]]
            yield pd.DataFrame({ident: batch[ident], "text": texts})

    return df.select(ident, ids).mapInPandas(run, T.StructType([_id_field(df, ident), T.StructField("text", T.StringType())]))
