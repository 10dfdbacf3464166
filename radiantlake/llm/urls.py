"""Parts of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (after the first :// up to /, ?, # or end, A-Z lower-cased) and path (from there up to ?, # or end); both empty if null or without ://."""
    rest = F.when(F.col(url).contains("://"), F.regexp_replace(F.col(url), r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host, path = (F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", group) for group in (1, 2))
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))
