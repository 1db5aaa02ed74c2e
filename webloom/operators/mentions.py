"""Brand mentions by an Aho-Corasick automaton: all spellings of all brands are found in one pass over each text.

Brands are dealt into lists of at most ``LIST_BYTES`` of names and spellings, each brand with all of its spellings in one; a list is one automaton, built
once for a worker and kept, and one pass over the texts. So what is broadcast is bounded, whatever the number of brands, and the result has what is found only:
``joins.mentions`` gives each answer with each of a few brands.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.scalars import brand_tokens
from webloom.sources.shared import keep

#: Some 16 bytes of automaton for each, in every worker.
LIST_BYTES = 8 << 20


def automaton(spellings: list[tuple[str, int]]):
    """An automaton whose values are the numbers of the brands of each spelling."""
    import ahocorasick

    numbers: dict[str, list[int]] = {}
    for text, number in spellings:
        numbers.setdefault(text, []).append(number)
    made = ahocorasick.Automaton()
    for text, own in numbers.items():
        made.add_word(text, own)
    made.make_automaton()
    return made


_KEPT: dict[str, object] = {}


def _finder(sent, name: str):
    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, spellings = sent.value
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = automaton(spellings)
        made = _KEPT[name]
        for texts in batches:
            out = []
            for text in texts:
                hit: set[int] = set()
                for _, own in made.iter(text) if len(made) else ():
                    hit.update(own)
                out.append(sorted(names[i] for i in hit))
            yield pd.Series(out, dtype=object)

    return find


def found(answers: DataFrame, brands: DataFrame, text: str = "answer_text", list_bytes: int = LIST_BYTES) -> DataFrame:
    """The answers' columns and brand: a row for each brand one of whose spellings an answer holds. Null texts hold none; brands that repeat are one, null and empty ones none."""
    spark = answers.sparkSession
    told = brands.select("brand").where("brand <> ''").distinct().select("brand", F.filter(brand_tokens(F.col("brand")), lambda t: t != "").alias("tokens"))
    size = F.octet_length("brand") + F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 16)
    told = keep(told.withColumn("size", size))
    lists = 1 + (told.agg(F.sum("size")).first()[0] or 0) // list_bytes
    out = None
    for n in range(lists):
        own = told.where(F.pmod(F.xxhash64("brand"), F.lit(lists)) == n).select("brand", "tokens").collect()  # about list_bytes
        sent = spark.sparkContext.broadcast(([r.brand for r in own], [(t, i) for i, r in enumerate(own) for t in r.tokens]))
        hits = _finder(sent, uuid.uuid4().hex)(F.lower(F.coalesce(text, F.lit(""))))
        part = answers.withColumn("_hits", hits).select(*answers.columns, F.explode("_hits").alias("brand"))
        out = part if out is None else out.unionByName(part)
    return out


def counts(answers: DataFrame, brands: DataFrame, text: str = "answer_text", **how) -> DataFrame:
    """brand, answers: how many answers mention each brand, of those that any does."""
    return found(answers.select(text), brands, text, **how).groupBy("brand").agg(F.count("*").alias("answers"))
