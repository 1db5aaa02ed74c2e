"""Structured data of pages as VARIANT columns: a block is parsed once, and every check reads the parsed value.

Blocks that are no JSON stay as null values in their places, so that counts of blocks don't change. A block's kinds are its @type, one or several; blocks inside @graph count as blocks
of their own in ``nodes``. Null lists give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.scalars import is_stale
from webloom.operators.rules import REQUIRED_PROPERTIES


def blocks(pages: DataFrame, key: str = "url", column: str = "structured_data") -> DataFrame:
    """key, pos, block (variant): a row for each block of each page."""
    return pages.select(key, F.posexplode(column).alias("pos", "_text")).select(key, "pos", F.try_parse_json("_text").alias("block"))


def text_at(block: Column, path: str) -> Column:
    """A value of a block as text; null where it isn't there."""
    return F.try_variant_get(block, path, "string")


def is_object(block: Column) -> Column:
    return F.startswith(F.schema_of_variant(block), F.lit("OBJECT"))


def kinds(block: Column) -> Column:
    """The names in @type: one, or those of a list."""
    many = F.try_variant_get(block, "$['@type']", "array<string>")
    one = text_at(block, "$['@type']")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def nodes(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, pos, node (variant), kind: a row for each kind of each block, and of each member of a block's @graph."""
    graph = F.try_variant_get("block", "$['@graph']", "array<variant>")
    every = parsed.where(is_object(F.col("block"))).select(key, "pos", F.explode(F.concat(F.array("block"), F.coalesce(graph, F.array().cast("array<variant>")))).alias("node"))
    return every.select(key, "pos", "node", F.explode(kinds(F.col("node"))).alias("kind"))


def _failed(block: Column) -> Column:
    e = text_at(block, "$._error")
    return e.isNotNull() & ~e.isin("", "false", "0", "[]", "{}")


def missing_fields(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, pos, kind, missing: blocks of a known first kind, and which of its required properties aren't there."""
    b = F.col("block")
    kind = F.get(kinds(b), 0)
    lacks = lambda fields: F.filter(F.array(*[F.when(F.try_variant_get(b, f"$['{f}']", "variant").isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    missing = F.coalesce(*[F.when(kind == name, lacks(fields)) for name, fields in REQUIRED_PROPERTIES.items()])
    got = parsed.where(is_object(b) & ~_failed(b)).select(key, "pos", kind.alias("kind"), missing.alias("missing"))
    return got.where(F.size("missing") > 0)


def invalid(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, pos of blocks that say an error."""
    return parsed.where(is_object(F.col("block")) & _failed(F.col("block"))).select(key, "pos")


def stale(parsed: DataFrame, now: Column, key: str = "url") -> DataFrame:
    """key, pos of blocks whose date of change, else of publication, is over a year old."""
    when = F.coalesce(F.nullif(text_at(F.col("block"), "$.dateModified"), F.lit("")), text_at(F.col("block"), "$.datePublished"))
    return parsed.where(is_object(F.col("block")) & F.coalesce(is_stale(when, now), F.lit(False))).select(key, "pos")
