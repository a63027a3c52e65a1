"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialise

_OTHER, _JOINING = re.compile(r"[\s\W_]+"), re.compile("[和及与]")


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


STOP_TOKENS = ["哪些", "什么", "需要", "要求", "负责", "相关", "能力", "岗位"]


def lexical_tokens(text: Column) -> Column:
    """Distinct tokens, longest first, then by code point: ASCII runs in lower case and every piece of 2 to 6
    characters of a Chinese run, without STOP_TOKENS."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+#./-]+"), F.lit(0)), F.lower)
    # A look-ahead consumes nothing, so pieces are found at every character.
    pieces = [F.regexp_extract_all(text, F.lit(f"(?=([\\x{{4e00}}-\\x{{9fff}}]{{{n}}}))"), F.lit(1)) for n in range(2, 7)]
    kept = F.array_except(F.concat(runs, *pieces), F.array(*[F.lit(t) for t in STOP_TOKENS]))
    return F.transform(F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def lexical_score(text: Column, tokens: list[str]) -> Column:
    """Over the query tokens present: 1 + 0.1 for each occurrence."""
    score = F.lit(0.0)
    for t in tokens:
        n = occurrences(text, t)
        score = score + F.when(n > 0, 1.0 + 0.1 * n).otherwise(0.0)
    return score


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def top(df: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    """The best rows above zero; the limit is clamped to 1..100."""
    return df.where(F.col(score) > 0).orderBy(F.desc(score), tie).limit(max(1, min(limit, 100)))


#: Queries that meet all rows in one pass; more make more passes.
QUERY_BLOCK = 4096


def top_cosine(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` rows nearest to each query by cosine, to six digits, ties by vec_id; a query does not meet itself.

    ``rows`` (vec_id, embedding) and ``queries`` (query_id, q), vectors of one width; null and zero vectors have cosine 0. A stated
    query set against all rows, in blocks: each pass sends QUERY_BLOCK queries to the workers (two megabytes for 64
    numbers), which keep their own best ``k``, so only those are shuffled.
    """
    spark = rows.sparkSession
    numbered = queries.where("query_id IS NOT NULL").select("query_id", "q").orderBy("query_id")
    schema = "query_id bigint, vec_id bigint, score double"
    out = None
    last = None
    while True:
        part = numbered if last is None else numbered.where(F.col("query_id") > last)
        block = part.limit(QUERY_BLOCK).toPandas()
        if not len(block):
            break
        ids = block["query_id"].to_numpy()
        width = max(len(v) for v in block["q"] if v is not None) if block["q"].notna().any() else 0
        unit = np.array([v if v is not None else np.zeros(width) for v in block["q"]], float)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)))

        def run(batches, sent=sent):
            ids, unit = sent.value
            best = pd.DataFrame({"query_id": ids[:0], "vec_id": ids[:0], "score": np.empty(0)})
            for b in batches:
                b = b[b["embedding"].notna()]
                if not len(b):
                    continue
                x = np.array(b["embedding"].tolist(), float)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                score = np.round(unit @ np.divide(x, size, out=np.zeros_like(x), where=size > 0).T, 6)
                vec = b["vec_id"].to_numpy()
                score[ids[:, None] == vec[None, :]] = -2.0
                # Rows beyond the k-th score of a batch are no query's best; equal ones stay for the tie.
                cut = np.partition(score, max(0, score.shape[1] - k), 1)[:, max(0, score.shape[1] - k)]
                r, c = np.nonzero((score >= cut[:, None]) & (score > -2.0))
                found = pd.concat([best, pd.DataFrame({"query_id": ids[r], "vec_id": vec[c], "score": score[r, c]})])
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                best = found[found.groupby("query_id").cumcount() < k]
            yield best

        near = rows.select("vec_id", "embedding").mapInPandas(run, schema)
        out = near if out is None else out.unionByName(near)
        last = int(ids[-1])
    if out is None:
        return spark.createDataFrame([], schema)
    return rank_within(out, ["query_id"], F.desc("score"), F.asc("vec_id")).where(F.col("rank") <= k).select("query_id", "vec_id", "score")


def hamming_pairs(df: DataFrame, key: str, block: str, bits: str, most: int = 8, width: int = 64) -> DataFrame:
    """Pairs (a, b) within a block whose signatures differ in at most ``most`` bits, exactly.

    Of most + 1 bands of bits at least one is equal in such a pair, so pairs meet in an equi-join on
    (block, band, value) instead of all against all, and count where the first of their equal bands
    meets; equal signatures are collapsed first, and pairs are emitted between distinct signatures
    only, named by their first key (``representatives`` has the copies of each).
    """
    distinct = representatives(df, key, block, bits)
    ends = [i * width // (most + 1) for i in range(most + 2)]
    masks = [((1 << hi) - (1 << lo)) - (1 << 64 if hi == 64 else 0) for lo, hi in zip(ends, ends[1:], strict=False)]
    common = lambda c, m: c.bitwiseAND(F.lit(m).cast("bigint"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), common(F.col(bits), m).alias("value")) for i, m in enumerate(masks)])
    cut = distinct.select(block, bits, "first", F.inline(bands))
    a = cut.select(block, "band", "value", F.col("first").alias("a"), F.col(bits).alias("bits_a"))
    b = cut.select(block, "band", "value", F.col("first").alias("b"), F.col(bits).alias("bits_b"))
    differ = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    met = F.coalesce(*[F.when(common(differ, m) == 0, i) for i, m in enumerate(masks)])
    near = a.join(b, [block, "band", "value"]).where("a < b").withColumn("distance", F.bit_count(differ))
    return near.where((F.col("distance") <= most) & (met == F.col("band"))).select(block, "a", "b", "distance")


def representatives(df: DataFrame, key: str, block: str, bits: str) -> DataFrame:
    """(block, bits, first, copies): the first key of each signature of a block and how many have it."""
    return df.groupBy(block, bits).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def simhash64(text: Column) -> Column:
    """64-bit signature over character bigrams as a bigint, null for null.

    Letters and digits of the lower-case text, without 和, 及 and 与; each bigram votes by its
    BLAKE2b-64, and a bit is set where the votes are not negative. No letters give 0.
    """

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype="Int64")
        seen: dict[str, int] = {}
        votes = np.zeros((0, 64), np.int8)
        filled = texts[texts.notna()]
        for at in range(0, len(filled), 128):
            part = filled.iloc[at : at + 128]
            plain = [_JOINING.sub("", _OTHER.sub("", t.lower())) for t in part]
            grams = [[t[i : i + 2] for i in range(max(1, len(t) - 1))] for t in plain]
            fresh = list(dict.fromkeys(g for each in grams for g in each if g not in seen))
            if fresh:
                hashed = b"".join(hashlib.blake2b(g.encode("utf-8"), digest_size=8).digest() for g in fresh)
                bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
                seen |= {g: len(votes) + i for i, g in enumerate(fresh)}
                votes = np.concatenate([votes, bits.astype(np.int8) * 2 - 1])
            starts = np.cumsum([0] + [len(g) for g in grams[:-1]])
            total = np.add.reduceat(votes[[seen[g] for each in grams for g in each]], starts, axis=0, dtype=np.int32)
            total[[not t for t in plain]] = -1
            out[part.index] = np.packbits(total >= 0, axis=1).view(">i8").ravel().astype(np.int64)
        return out

    return run(text)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, first): the least key of each key's component, for keys other than it; ``edges`` has (a, b)."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        # Large star, then small star: neighbours are hooked to the least key they can see.
        sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialise(small, "edges")
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            return e.select(F.col("a").alias("key"), F.col("b").alias("first"))
        e = nxt
    raise RuntimeError(f"components not settled in {rounds} rounds")


def rank_within(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
