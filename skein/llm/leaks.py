"""Evaluation passages that leak into a corpus: a prefix-filtered set join.

Items and documents are cut into shingles: ``CHARS`` characters where a shingle begins in Han text, ``WORDS`` words
elsewhere, so a passage is cut alike whatever surrounds it. Each shingle weighs the less the more documents
have it, so that common phrases count for little. An item's shingles are ordered by rarity, and the commonest, with
REST of its weight, are left out of the join: a document that holds the wanted share of an item must
hold all but REST of that share in the prefix that remains. Documents are joined with the prefixes alone, and
only pairs that reach this bound are verified: the document is cut into windows of the item's size, windows
with next to nothing of the item are set aside (one shared sentence is no leak), and the share of the item's
weight found in the other windows decides. Single exchanged words break the shingles across them only.

Document frequencies are counted over all documents, for the items' shingles; documents' other shingles never leave
the workers. What a worker needs to know of the items is a bit set of fixed size (``Sieve``), however many
items there are; what passes it is checked exactly by a join.

Null and empty texts give no cases; items without any shingle leak nowhere; repeated documents each
give their rows; ties in rarity are ordered by the shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialise

WORDS, CHARS = 3, 4
#: Share of an item's shingle weight that a document must hold. Half of a passage with one word in
#: eight exchanged keeps about a third of its shingles; unrelated documents stay under a quarter.
SHARE = 0.34
#: A window of the item's size counts if it holds at least this share of the item's weight.
WINDOW_SHARE = 0.08
#: The document frequency, as a share of all documents, at which a shingle's weight has halved.
COMMON = 0.003
#: Share of an item's weight, its commonest shingles, that is left out of the prefix join.
REST = 0.1
#: Rows of the items' shingles, some 40 bytes each, up to which they are sent to every worker; more are shuffled.
SENT_ROWS = 1 << 20
#: Words of 64 bits in a sieve: 8 MB.
SIEVE_WORDS = 1 << 20

_MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->|&[a-zA-Z#0-9]{1,8};|[\u200b\u200c\u200d\ufeff]")
_TOKEN = re.compile(r"[a-z0-9]+|[㐀-鿿]|[^\W_a-z0-9㐀-鿿]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Tokens(dict):
    """The 64-bit hashes of tokens, odd for a Han character; known ones are kept, a million at most."""

    def __missing__(self, t: str) -> int:
        h = (xxhash.xxh64_intdigest(t) & ~1) | ("㐀" <= t <= "鿿")
        self[t] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self) > 1_000_000:
            self.clear()
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _MARKUP.sub("", text))
        elif "<" in text or "&" in text:
            text = _MARKUP.sub("", text)
        return list(map(self.__getitem__, _TOKEN.findall(text.lower())))


def shingles(texts: list[str | None], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every shingle of the texts, in order."""
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, x in enumerate(texts):
        at = len(flat)
        flat += tokens.of(x)
        sizes[i] = len(flat) - at
    t = np.array(flat, np.int64).view(np.uint64)
    if not len(t):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(t))  # tokens from here to the text's end
    pad = np.concatenate([t, np.zeros(CHARS, np.uint64)])
    h = mix(pad[: len(t)])
    for k in range(1, WORDS):
        h = mix(h * _MIX[2] + pad[k : k + len(t)])
    han = (t & np.uint64(1)) == 1
    longer = h
    for k in range(WORDS, CHARS):
        longer = mix(longer * _MIX[2] + pad[k : k + len(t)])
    ok = left >= np.where(han, CHARS, WORDS)
    pos = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return doc[ok], pos[ok], np.where(han, longer, h).view(np.int64)[ok]


def sieve_bits(values: np.ndarray) -> Iterator[np.ndarray]:
    """The two bits of each 64-bit value in a sieve."""
    h = mix(values.view(np.uint64))
    for s in (0, 29):
        yield ((h >> np.uint64(s)) % np.uint64(SIEVE_WORDS * 64)).astype(np.int64)


def sieve(df: DataFrame, column: str):
    """A broadcast bit set of fixed size of a bigint column: every value put in passes, and few others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.unique(np.concatenate(list(sieve_bits(b["v"].to_numpy(np.int64)))))
            yield pd.DataFrame({"word": bits >> 6, "mask": np.left_shift(np.int64(1), bits & 63)})

    words = df.select(F.col(column).alias("v")).mapInPandas(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = words.toPandas()  # SIEVE_WORDS rows at most
    table = np.zeros(SIEVE_WORDS, np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return df.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    found = np.ones(len(values), bool)
    for bit in sieve_bits(values):
        found &= (table[bit >> 6] >> (bit & 63)) & 1 == 1
    return found


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, h, size): every distinct shingle of each item, and how many shingles the item has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for b in batches:
            which, _, h = shingles(b["text"].tolist(), tokens)
            size = np.bincount(which, minlength=len(b))
            yield pd.DataFrame({"item_id": b["key"].to_numpy()[which], "h": h, "size": size[which].astype(np.int32)})

    cut = items.select(F.col("item_id").alias("key"), F.col("passage").alias("text")).mapInPandas(run, "item_id bigint, h bigint, size int")
    return cut.groupBy("item_id", "h").agg(F.max("size").alias("size"))


def frequencies(docs: DataFrame, wanted) -> DataFrame:
    """(h, df): in how many documents each shingle that passes the sieve ``wanted`` occurs, in parts to be summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for b in batches:
            which, _, h = shingles(b["text"].tolist(), tokens)
            keep = passes(wanted.value, h)
            order = np.lexsort((which[keep], h[keep]))
            which, h = which[keep][order], h[keep][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
            found, n = np.unique(h[new], return_counts=True)
            yield pd.DataFrame({"h": found, "n": n})

    return docs.select("text").mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("df"))


def hits(docs: DataFrame, wanted, only=None) -> DataFrame:
    """(doc_id, pos, h) of the shingles that pass ``wanted``, of the documents whose number passes ``only``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for b in batches:
            if only is not None:
                b = b[passes(only.value, b["doc_id"].to_numpy(np.int64))]
            which, pos, h = shingles(b["text"].tolist(), tokens)
            keep = passes(wanted.value, h)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[which[keep]], "pos": pos[keep].astype(np.int32), "h": h[keep]})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id bigint, pos int, h bigint")


def holders(docs: DataFrame, wanted) -> DataFrame:
    """(doc_id, h): the distinct shingles of each document that pass ``wanted``. A document that has several rows may give a
    shingle once for each; its sum is then an upper bound, and the verification exact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for b in batches:
            which, _, h = shingles(b["text"].tolist(), tokens)
            keep = passes(wanted.value, h)
            doc, h = b["doc_id"].to_numpy()[which[keep]], h[keep]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            yield pd.DataFrame({"doc_id": doc[new], "h": h[new]})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "doc_id bigint, h bigint")


def sent(df: DataFrame) -> DataFrame:
    """``df`` for the small side of a join: broadcast up to SENT_ROWS rows, else as it is."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) for ``docs`` (doc_id, text) and ``items`` (item_id, passage)."""
    n_docs = docs.count()
    wanted = materialise(item_shingles(items), "items")
    any_item = sieve(wanted, "h")
    # The exact join of the sums is with the items' own shingles; what else passed the sieve ends here.
    df = materialise(frequencies(docs, any_item).join(wanted.select("h").distinct(), "h", "left_semi"), "df")
    weight = df.withColumn("w", COMMON / (COMMON + F.col("df") / F.lit(float(max(1, n_docs)))))
    whole = Window.partitionBy("item_id")
    rarest = whole.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    weighed = wanted.join(weight, "h", "left").fillna({"df": 0, "w": 1.0})
    weighed = materialise(weighed.withColumns({"total": F.sum("w").over(whole), "before": F.coalesce(F.sum("w").over(rarest), F.lit(0.0))}), "weighed")
    # The prefix leaves out REST of the weight at most, so a document with the wanted share of an item
    # holds at least share - REST of it in prefix shingles. What no document holds is not looked for.
    prefix = weighed.where((F.col("before") <= (1 - REST) * F.col("total")) & (F.col("df") > 0)).select("item_id", "h", "w", "total")
    met = holders(docs, sieve(prefix, "h")).join(sent(prefix), "h").groupBy("doc_id", "item_id").agg((F.sum("w") / F.max("total")).alias("held"))
    pairs = materialise(met.where(F.col("held") >= share - REST).select("doc_id", "item_id"), "pairs")
    found = hits(docs, any_item, sieve(pairs.select("doc_id").distinct(), "doc_id"))
    found_in = found.join(pairs, "doc_id").join(sent(weighed.select("item_id", "h", "w", "size", "total")), ["item_id", "h"])
    # Positional bound: two sets of item-sized windows, half a window apart.
    windows = found_in.select(
        "doc_id", "item_id", "h", "w", "total",
        F.explode(F.array(F.floor(F.col("pos") / F.col("size")) * 2, F.floor((F.col("pos") + F.col("size") / 2) / F.col("size")) * 2 + 1)).alias("window"),
    ).distinct()
    windows = materialise(windows, "windows")
    held = windows.groupBy("doc_id", "item_id", "window").agg((F.sum("w") / F.max("total")).alias("held"))
    kept = windows.join(held.where(F.col("held") >= WINDOW_SHARE), ["doc_id", "item_id", "window"])
    union = kept.select("doc_id", "item_id", "h", "w", "total").distinct()
    return union.groupBy("doc_id", "item_id").agg((F.sum("w") / F.max("total")).alias("share")).where(F.col("share") >= share)
