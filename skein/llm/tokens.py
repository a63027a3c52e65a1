"""Encoding a corpus by a byte-level BPE vocabulary, each distinct word once.

Texts are cut into pre-tokens with their positions; the distinct pre-tokens are shuffled together and encoded
once each; their ids are joined back and reassembled by position. Decoding joins the table of the tokens' bytes.

Positions are pre-aggregated before anything is shuffled: the texts of a block (BLOCK_CHARS characters of one
partition, or one longer text) are cut together, and a distinct word of the block is one row with all its
positions, as packed differences. A frequent word such as a space is therefore one row per block, never a
row per use, and no group is larger than a block.

A text that is null or empty has an empty list of ids. Special tokens' strings are ordinary text.
Repeated rows are encoded each, and long texts whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialise

# The published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts whose pre-tokens are aggregated together.
BLOCK_CHARS = 1 << 22


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def cutter():
    """The compiled pattern, with white space as Unicode defines it."""
    import regex

    space = r"\p{White_Space}"
    return regex.compile(PATTERN.replace(r"[^\s", rf"[^{space}").replace(r"\S", rf"\P{{White_Space}}").replace(r"\s", space), regex.V0)


def squeeze_ints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value) of non-negative integers, seven bits to a byte, low ones first."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 5):
        sizes += values >= 1 << (7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for k in range(5):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[starts[has] + k] = ((values[has] >> (7 * k)) & 127).astype(np.uint8) | more
    return out, sizes


def spread_ints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offset of the end of each) of ``squeeze_ints``' bytes."""
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    parts = (data & 127).astype(np.int64) << (7 * place)
    return (np.add.reduceat(parts, starts) if len(starts) else parts), last + 1


def pieces(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the values, bytes) of a binary column without nulls, without a Python object per value."""
    data, ends, at = [], [], 0
    for c in column.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        if len(c):
            data.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8))
            ends.append(offsets[1:] - offsets[0] + at)
            at += int(offsets[-1] - offsets[0])
    return (np.concatenate(ends), np.concatenate(data)) if ends else (np.empty(0, np.int64), np.empty(0, np.uint8))


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def cut_blocks(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, word, at): a row per block and distinct word with its positions ``at``, and one per block with a null word,
    whose ``at`` holds the documents' identifiers and numbers of pre-tokens."""

    def block(cut, name: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
        seen: dict[str, int] = {}
        counts, spots = [], []
        for t in texts:
            words = cut.findall(t) if t else []
            counts.append(len(words))
            spots += [seen.setdefault(w, len(seen)) for w in words]
        which = np.array(spots, np.int32)
        order = np.argsort(which, kind="stable")
        uses = np.bincount(which, minlength=len(seen))
        first = np.cumsum(uses) - uses
        steps = np.diff(order, prepend=0)
        steps[first] = order[first]
        data, sizes = squeeze_ints(steps)
        ends = np.cumsum(sizes)[first + uses - 1]
        docs = np.array([ids, counts], np.int64).view(np.uint8).ravel()
        at = binaries(np.append(ends, len(data) + len(docs)), np.concatenate([data, docs]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen) + 1, name)), pa.array([*seen, None], pa.string()), at], ["block", "word", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[str] = []
        chars = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield block(cut, number, ids, texts)
                    number, ids, texts, chars = number + 1, [], [], 0
        if ids:
            yield block(cut, number, ids, texts)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "block bigint, word string, at binary")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of the distinct rows of ``words``; each worker loads the vocabulary once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("skein", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(path), special_tokens={})
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [np.array(encoding._encode_single_piece(w), np.int32).tobytes() for w in b["word"]]})

    return words.mapInPandas(run, "word string, ids binary")


def assemble(table: pa.Table) -> pa.Table:
    """(doc_id, ids) of one block's rows (word, at, ids)."""
    is_word = pc.is_valid(table["word"])
    docs = np.frombuffer(table.filter(pc.invert(is_word))["at"][0].as_py(), np.int64).reshape(2, -1)
    words = table.filter(is_word)
    cuts, data = pieces(words["at"])
    steps, ends = spread_ints(data)
    owner = np.searchsorted(cuts, ends - 1, side="right")
    # Positions are running sums that begin anew with each word.
    total = np.cumsum(steps)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    at = total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(owner)))) if len(owner) else total
    word_at = np.empty(len(at), np.int64)
    word_at[at] = owner
    id_ends, raw = pieces(words["ids"])
    sizes = np.diff(id_ends, prepend=0) // 4
    pool = raw.view(np.int32)
    begins = np.cumsum(sizes) - sizes
    each = sizes[word_at]
    out_ends = np.cumsum(each)
    flat = pool[np.repeat(begins[word_at] - (out_ends - each), each) + np.arange(int(out_ends[-1]) if len(out_ends) else 0)]
    to = np.concatenate([[0], np.concatenate([[0], out_ends])[np.cumsum(docs[1])]]).astype(np.int32)
    return pa.table([pa.array(docs[0]), pa.ListArray.from_arrays(pa.array(to), pa.array(flat))], ["doc_id", "ids"])


def encode(df: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = path or vocabulary()
    spots = materialise(cut_blocks(df, doc_id, text), "spots")
    ids = encode_words(spots.where("word IS NOT NULL").select("word").distinct(), path)
    placed = spots.where("word IS NOT NULL").join(ids, "word").select("block", "word", "at", "ids")
    docs = spots.where("word IS NULL").select("block", "word", "at", F.lit(None).cast("binary").alias("ids"))
    return placed.unionByName(docs).groupBy("block").applyInArrow(assemble, "doc_id bigint, ids array<int>")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes) of every token of a vocabulary."""
    rows = [(i, bytearray(b)) for b, i in ranks_of(path or vocabulary()).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "bytes"]).assign(bytes=lambda d: d["bytes"].map(bytes)), "id int, bytes binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse of ``encode``; an empty list gives an empty text."""
    e = encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id())
    each = e.select("doc_id", "row", F.posexplode("ids").alias("pos", "id")).join(token_bytes(encoded.sparkSession, path), "id")
    joined = each.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8")
    none = e.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text"))
    return joined.select("doc_id", text.alias("text")).unionByName(none)
