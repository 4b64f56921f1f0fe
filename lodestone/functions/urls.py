"""URLs as columns. Patterns use neither lookaround nor backreferences, so other SQL engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files that aren't pages.
ASSETS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "mp4", "pdf", "zip")


def origin(url: Column) -> Column:
    """scheme://authority, '' where there is none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normal_url(url: Column) -> Column:
    """Without trailing slashes: the key that duplicates share."""
    return F.regexp_replace(url, r"/+$", "")


def slug(url: Column) -> Column:
    """The path with -- for /, 'index' for the root. Host, query and fragment are left out."""
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"^/+", ""), r"/+$", "")
    return F.when(path == "", "index").otherwise(F.replace(path, F.lit("/"), F.lit("--")))


def has_asset_suffix(url: Column) -> Column:
    return F.lower(F.regexp_extract(url_path(url), r"\.([A-Za-z0-9]+)$", 1)).isin(*ASSETS)


def is_page(url: Column, base: Column) -> Column:
    """Of the same origin, or relative, and no asset."""
    return ((origin(url) == base) | (origin(url) == "")) & ~has_asset_suffix(url)
