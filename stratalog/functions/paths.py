"""The form of paths, and the paths above them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """All trailing slashes go, but "/" stays; no leading one is added."""
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def valid(path: Column) -> Column:
    """Not empty, from the root, without "..", without a slash at its end unless it is the root."""
    return F.coalesce((path == "/") | (path.startswith("/") & ~path.contains("..") & ~path.endswith("/")), F.lit(False))


def parent(path: Column) -> Column:
    """Null for the root, "/" for the first level."""
    above = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(path == "/", F.lit(None)).when(above == "", F.lit("/")).otherwise(above)


def of_prefix(prefix: Column) -> Column:
    """The directory that an object prefix names: its parts without empty ones, from the root."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.coalesce(prefix, F.lit("")), "/"), lambda p: p != ""), "/"))


def ancestors(path: Column, own: bool = False) -> Column:
    """All paths above a path, the root first, and with `own` the path itself."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    deep = F.size(parts) - (0 if own else 1)
    above = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    root = F.array(F.lit("/"))
    return F.when(F.size(parts) == 0, root if own else F.array().cast("array<string>")).otherwise(F.concat(root, above))
