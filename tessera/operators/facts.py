"""Numeric facts of texts, and how many of a claim's facts a source can stand for at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, normalize_number, normalize_whitespace
from tessera.operators.quantities import full_flow
from tessera.operators.relations import most_pairs

#: Currency, number, and the unit or noun right after it.
FACT = r"([$€£¥]?)(\d[\d,]*(?:\.\d+)?)[ \t]*(%|[A-Za-z]+)?"
# Units that are written in several ways.
UNITS = {"percent": "%", "hr": "hour", "hrs": "hour", "min": "minute", "mins": "minute", "sec": "second", "secs": "second", "wk": "week", "yr": "year", "yrs": "year", "usd": "$", "eur": "€"}


def numeric_facts(text: Column) -> Column:
    """The facts of a text in order, repeats included: structs of currency, value and unit.

    Values are normalised, units in lower case, singular, and in one spelling; a unit that names a
    currency is one; a word without meaning, as in "5 to", is no unit. Empty for null.
    """
    plain = normalize_whitespace(text)
    part = lambda i: F.regexp_extract_all(plain, F.lit(FACT), F.lit(i))
    known = F.create_map(*[F.lit(x) for item in UNITS.items() for x in item])
    named = lambda u: F.coalesce(known[F.lower(u)], known[F.regexp_replace(F.lower(u), "s$", "")], F.regexp_replace(F.lower(u), r"(?<=..)s$", ""))

    unit = lambda u: F.when(F.lower(u).isin(STOP_WORDS), "").otherwise(named(u))

    def fact(pair: Column, u: Column) -> Column:
        money = unit(u).isin("$", "€")
        return F.struct(
            F.when(pair["c"] != "", pair["c"]).when(money, unit(u)).otherwise("").alias("currency"), normalize_number(pair["v"]).alias("value"), F.when(money, "").otherwise(unit(u)).alias("unit")
        )

    pairs = F.zip_with(part(1), part(2), lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    return F.coalesce(F.zip_with(pairs, part(3), fact), F.array().cast("array<struct<currency:string,value:string,unit:string>>"))


def agree(claimed: tuple, held: tuple, strict: bool) -> bool:
    """Of (currency, value, unit): equal values in one currency, and equal units; unless strict, a fact
    without a unit fits any."""
    return claimed[:2] == held[:2] and (claimed[2] == held[2] or (not strict and "" in (claimed[2], held[2])))


def matching(fits: list[list[int]]) -> int:
    """The most claims that can each have a support of its own; fits[claim] lists those that suit it."""
    return most_pairs(fits, 1 + max((s for each in fits for s in each), default=-1))


def supported_facts(said: list[tuple], held: list[tuple], strict: bool) -> int:
    """How many facts of said each find one of held for themselves; equal facts are one class with a count."""
    need, have = Counter(said), Counter(held)
    by_value: dict[str, list[int]] = {}
    for k, fact in enumerate(have):
        by_value.setdefault(fact[1], []).append(k)
    kinds = list(have)
    return full_flow(list(need.values()), list(have.values()), [[k for k in by_value.get(f[1], []) if agree(f, kinds[k], strict)] for f in need])


def fact_support(pairs: DataFrame, keys: tuple[str, ...], strict: bool = False) -> DataFrame:
    """keys, facts, matched, supported of pairs (keys, claim, source: texts): each fact of the claim
    needs one of the source for itself, so that one number can't stand for two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[[tuple(f.values()) for f in facts] for facts in batch.column(c).to_pylist()] for c in ("said", "held")]
            matched = [supported_facts(said, held, strict) for said, held in zip(*lists)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([len(x) for x in lists[0]], pa.int64()), pa.array(matched, pa.int64())], [*keys, "facts", "matched"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    rows = pairs.select(*keys, numeric_facts(F.col("claim")).alias("said"), numeric_facts(F.col("source")).alias("held"))
    return rows.mapInArrow(run, f"{kinds}, facts long, matched long").withColumn("supported", F.col("facts") == F.col("matched"))
