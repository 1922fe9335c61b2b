"""Choice and search of instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(instruments: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first `limit` instruments, by symbol, with the text in symbol, name or description, whatever the case; none for a blank text."""
    text = query.strip().lower()
    hit = F.lit(False)
    for c in ("symbol", "name", "description"):
        hit = hit | F.coalesce(F.lower(c).contains(text), F.lit(False))
    return instruments.where(hit if text else F.lit(False)).orderBy("symbol").limit(limit)


def in_scope(df: DataFrame, scope: str, symbols: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
    """Rows of one symbol (`single`), of all (`all`) or of a list (`custom`), whatever the case."""
    if scope == "all":
        return df
    if scope == "single":
        return df.where(F.lower("symbol") == (symbol or "").lower())
    if scope == "custom" and symbols is not None:
        named = symbols.select(F.lower("symbol").alias("_symbol")).distinct()
        return df.join(named, F.lower(df["symbol"]) == named["_symbol"], "left_semi")
    raise ValueError(f"unknown scope: {scope}")


def unknown(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """Listed symbols that the catalogue does not have."""
    known = instruments.select(F.lower("symbol").alias("_symbol")).distinct()
    return symbols.join(known, F.lower(symbols["symbol"]) == known["_symbol"], "left_anti")


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in an order fixed by the seed."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
