"""Answers from numbered evidence, with what they cite checked; embeddings by a provider the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import fields


class EmbeddingProvider(Protocol):
    """Vectors of texts; made anew in each worker by the factory that ``embed`` is given."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


def embed(df: DataFrame, key: str, text: str, factory: Callable[[], EmbeddingProvider]) -> DataFrame:
    """(key, vector) of every row with a text, a batch of texts at a time."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b["key"], "vector": provider.embed_documents(b["text"].tolist())})

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, vector array<float>")


@dataclass(frozen=True)
class Answer:
    text: str
    mode: str
    valid: bool


def prompt(question: str, evidence: list[dict]) -> str:
    lines = "\n".join(f"[{e['cite']}] {e['title']} | {e['text']}" for e in evidence)
    return f"只依据下列编号证据回答，每个结论至少引用一个[K编号]，证据不足时直接说明。\n\n问题：{question}\n\n证据：\n{lines}"


def extract(evidence: list[dict], most: int = 3, width: int = 180) -> str:
    return "\n".join(f"- [{e['cite']}] {e['title']}：{' '.join(e['text'].split())[:width]}" for e in evidence[:most])


def valid(text: str, evidence: list[dict]) -> bool:
    """Whether an answer cites something, and nothing but the evidence."""
    import re

    cited = {f"K{n}" for n in re.findall(r"\[K(\d+)\]", text or "")}
    return bool(cited) and cited <= {e["cite"] for e in evidence}


def answer(question: str, evidence: DataFrame, invoke: Callable[[str], str] | None = None) -> Answer:
    """An answer by ``invoke``, a model outside the plan, if it keeps to its evidence; else the evidence itself.

    ``evidence`` (cite, title, text) is a top-k report of a dozen rows at most; more are an error, as is none.
    """
    rows = [r.asDict() for r in evidence.select("cite", "title", "text").orderBy(F.length("cite"), "cite").limit(13).collect()]
    if not rows or len(rows) > 12:
        raise ValueError("no evidence" if not rows else "more evidence than an answer can cite")
    if invoke is not None:
        try:
            said = invoke(prompt(question, rows))
        except Exception:  # whatever a model's client raises, the evidence remains
            said = ""
        if valid(said, rows):
            return Answer(said, "model", True)
    text = extract(rows)
    return Answer(text, "extract", valid(text, rows))


def enrich(skills: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """``skills`` (key, skill, rank, sources) with those of ``found`` (key, skill, rank, quote) whose quotation stands in the
    text (key, text): one row per key and skill, of the higher rank and all sources."""
    kept = found.join(texts, "key").where(fields.grounded(F.col("quote"), F.col("text"))).select("key", "skill", "rank", F.array(F.lit("model")).alias("sources"))
    both = skills.select("key", "skill", "rank", "sources").unionByName(kept)
    return both.groupBy("key", "skill").agg(F.max("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
