"""Stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL name space of version 5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(asset: Column, page: Column, text: Column) -> Column:
    """The id of a text point, by its content: it does not shift when rows before it go, and an edited text is another point."""
    return uuid5(F.concat(F.lit("text:"), F.coalesce(asset, F.lit("")), F.lit(":"), F.coalesce(page.cast("string"), F.lit("None")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
