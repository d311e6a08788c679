"""Small column expressions shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Time formats tried in this order for crawled timestamps.
CRAWL_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm")

# Radii in use, km for distances on the map and m for gradients.
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6_371_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or null when it is null, NaN or infinite."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def normalise_lon(c: str | Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(col(c) + 180.0, F.lit(360.0)) - 180.0


def lon_distance(a: str | Column, b: str | Column) -> Column:
    """Circular distance in degrees between two longitudes."""
    return F.abs(normalise_lon(normalise_lon(a) - normalise_lon(b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC").str.strip()


def clean_text(c: str | Column) -> Column:
    """NFKC form without outer blanks; null becomes the empty text.

    SQL has no ``normalize``. Plain ASCII is already in NFKC form and is trimmed in the JVM; only other
    texts carry content through Arrow.
    """
    value = col(c).cast("string")
    plain = F.length(value) == F.octet_length(value)
    blanks = F.lit("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
    return F.coalesce(F.when(plain, F.trim(value, blanks)), _nfkc(F.when(~plain, value)), F.lit(""))


def safe_key(c: str | Column, length: int = 100, default: str = "unnamed") -> Column:
    """File-safe form of a text: unsafe characters to ``_``, outer blanks and dots cut, then shortened."""
    text = F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit(default))
    text = F.trim(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    return F.coalesce(F.nullif(F.substring(text, 1, length), F.lit("")), F.lit(default))


def safe_token(c: str | Column, default: str = "nameless") -> Column:
    """Letters, digits, CJK ideographs, ``_`` and ``-`` only; runs of anything else become one ``_``."""
    text = F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))
    return F.regexp_replace(text, r"[^0-9A-Za-z一-鿿_-]+", "_")


def parse_time(c: str | Column, formats: Sequence[str] = CRAWL_TIME_FORMATS) -> Column:
    """First format that parses, else null."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def blank_to_default(c: str | Column, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(default))


def track_time(c: str | Column) -> dict[str, Column]:
    """UTC text ``yyyyMMddHHmm`` with its UTC+8 twin and ISO form; unparseable text keeps only itself."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    utc = F.try_to_timestamp(F.when(F.length(text) == 12, text), F.lit("yyyyMMddHHmm"))
    return {
        "time_utc": text,
        "time_bj": F.coalesce(F.date_format(utc + F.expr("INTERVAL 8 HOURS"), "yyyyMMddHHmm"), F.lit("")),
        "time_iso": F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
    }


def matched_keywords(keywords: Sequence[str], *texts: str | Column) -> Column:
    """The keywords (in list order, joined by ``;``) that occur in any of the texts, ignoring case."""
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    hits = [F.when(F.contains(haystack, F.lit(k.lower())), F.lit(k)) for k in keywords]
    return F.concat_ws(";", *hits)


def page_title(html: str | Column) -> Column:
    """The title of an HTML page, white space folded; empty without one."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_text(html: str | Column) -> Column:
    """The whole text of an HTML page without scripts, styles, comments and tags, white space folded."""
    bare = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def inverse_normal(p: str | Column) -> Column:
    """Standard normal quantile for 0 < p < 1 by a rational approximation (relative error about 1e-9)."""
    # Coefficients of Acklam's published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(x: Column, coefficients: Sequence[float]) -> Column:
        total = F.lit(coefficients[0])
        for k in coefficients[1:]:
            total = total * x + k
        return total

    q = col(p)
    tail = F.sqrt(-2.0 * F.log(F.least(q, 1 - q)))
    outer = horner(tail, c) / (horner(tail, d) * tail + 1.0)
    mid = q - 0.5
    square = mid * mid
    inner = horner(square, a) * mid / (horner(square, b) * square + 1.0)
    return F.when(q < 0.02425, outer).when(q > 1 - 0.02425, -outer).otherwise(inner)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Only the required columns; an error names those that are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required)
