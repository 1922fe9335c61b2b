"""Scalar rules of the lake as Column functions. All times are UTC; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FACTOR = 100_000
#: Timeframe spellings, the timeframe that is fetched for each, folder names and widths.
ALIASES = {"tick": "tick", "m1": "m1", "1m": "m1", "m15": "m15", "15m": "m15", "h1": "h1", "1h": "h1", "h4": "h4", "4h": "h4"}
PRIMITIVE = {"tick": "tick", "m1": "m1", "m15": "m1", "h1": "h1", "h4": "h1"}
FOLDERS = {"tick": "tick", "m1": "1min", "m15": "15min", "h1": "1h", "h4": "4h"}
#: The file of a raw chunk, of ticks by hour.
CHUNK_FILES = {"tick": "%02dh_ticks.bi5", "m1": "BID_candles_min_1.bi5", "h1": "BID_candles_hour_1.bi5"}
WIDTH_MS = {"m1": 60_000, "m15": 900_000, "h1": 3_600_000, "h4": 14_400_000}


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key]


def timeframe(name: Column) -> Column:
    """The canonical timeframe; an unknown one raises an error."""
    found = lookup(ALIASES, F.lower(F.trim(name)))
    return F.when(found.isNotNull() | name.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown timeframe: "), name)).cast("string"))


def timeframes(names: Column) -> Column:
    """Canonical timeframes of a comma-separated list, each once, in order."""
    return F.array_distinct(F.transform(F.split(names, ","), timeframe))


def primitive(name: Column) -> Column:
    return lookup(PRIMITIVE, name)


def folder(name: Column) -> Column:
    return lookup(FOLDERS, name)


def timeframe_of_folder(name: Column) -> Column:
    return lookup({v: k for k, v in FOLDERS.items()}, F.lower(name))


def tick_time(base_ms: Column, offset_ms: Column) -> Column:
    return base_ms + offset_ms


def bar_time(base_ms: Column, offset_s: Column) -> Column:
    return base_ms + offset_s.cast("bigint") * 1000


def scale_price(price: Column, factor: Column) -> Column:
    """A price as fixed-point integer, half-even; out of range raises an error in ANSI mode."""
    return F.bround(price * factor).cast("int")


def unscale_price(price: Column, factor: Column) -> Column:
    return (price.cast("float") / factor).cast("float")


def to_ms(value: Column) -> Column:
    """Milliseconds of an integer (as it is) or an ISO-8601 string, with or without offset (none: UTC), floored; else null."""
    text = F.trim(value.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(text.try_cast("timestamp"))))


def iso_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSSxxx")


def iso_s(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ssxxx")


def resolve_factor(override: Column, factor: Column) -> Column:
    """The override unless null or 0, else the symbol's factor, else the default."""
    return F.coalesce(F.nullif(override, F.lit(0)), factor, F.lit(DEFAULT_FACTOR))


def chunk_key(symbol: Column, name: Column, dt: Column, hour: Column) -> Column:
    """Storage key of a raw chunk: hours of ticks, days of minute bars, months of hour bars; months count from 0."""
    place = F.format_string("%s/%d/%02d", F.upper(symbol), F.year(dt), F.month(dt) - 1)
    day = F.format_string("%02d", F.day(dt))
    file = {k: F.format_string(v, F.coalesce(hour, F.lit(0))) if "%" in v else F.lit(v) for k, v in CHUNK_FILES.items()}
    return F.when(name == "tick", F.concat_ws("/", place, day, file["tick"])).when(name == "m1", F.concat_ws("/", place, day, file["m1"])).when(name == "h1", F.concat_ws("/", place, file["h1"]))


def canonical_path(base: Column, symbol: Column, name: Column, month: Column) -> Column:
    """Path of a table file; ticks have a file per month (YYYY_MM)."""
    place = folder(name)
    stem = F.concat_ws("_", symbol, place, F.when(name == "tick", month))
    return F.concat(F.concat_ws("/", base, symbol, place, stem), F.lit(".parquet"))


def parquet_path(csv: Column) -> Column:
    return F.regexp_replace(csv, r"\.csv$", ".parquet")


def month_key(name: Column) -> Column:
    """YYYY_MM of a tick file name; null if malformed."""
    return F.nullif(F.regexp_extract(name, r"_(\d{4}_(?:0[1-9]|1[0-2]))(?:[_.]|$)", 1), F.lit(""))


def month_closed(dt: Column, as_of: Column) -> Column:
    return F.last_day(dt) < as_of


def pct_change(price: Column, previous: Column) -> Column:
    return F.when(previous > 0, (price - previous) / previous * 100)


def ticker_name(ticker: Column) -> Column:
    return F.upper(F.replace(F.replace(ticker, F.lit("=X"), F.lit("")), F.lit("-"), F.lit("")))


def price_text(price: Column) -> Column:
    """A price with digits by its size; null or NaN is `--`."""
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", price), "0+$", ""), r"\.$", "")
    return (
        F.when(price.isNull() | F.isnan(price), "--")
        .when(price >= 1000, F.format_number(price, 2))
        .when(price >= 100, F.format_string("%.2f", price))
        .when(price >= 1, trimmed)
        .otherwise(F.format_string("%.5f", price))
    )


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike("^[A-Z0-9/]{2,12}$"), F.lit(False))


def valid_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD text; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def ratio(num: Column, den: Column) -> Column:
    """num / den; null where den is not over 0."""
    return F.when(den > 0, num / den)
