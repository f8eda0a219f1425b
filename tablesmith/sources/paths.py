"""Mapping of paths from old places to new ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where mounted storage appears.
MOUNTS = ("/mnt/", "/dbfs/mnt/")


def _longest_first(mapping: Mapping[str, str]) -> list[tuple[str, str]]:
    pairs = [(old.rstrip("/"), new.rstrip("/")) for old, new in mapping.items()]
    return sorted(pairs, key=lambda pair: len(pair[0]), reverse=True)


def map_path(path: str, mapping: Mapping[str, str]) -> str:
    """Replace the longest matching leading folder; ``/mnt/a`` does not match ``/mnt/ab``."""
    for old, new in _longest_first(mapping):
        if path == old or path.startswith(old + "/"):
            return new + path[len(old) :]
    return path


def map_paths(path: Column, mapping: Mapping[str, str]) -> Column:
    """The same for a column of paths."""
    result = path
    for old, new in reversed(_longest_first(mapping)):
        inside = (path == old) | path.startswith(old + "/")
        result = F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(result)
    return result


def is_mount(path: Column) -> Column:
    """Does the path lie on mounted storage?"""
    return F.coalesce(path.startswith(MOUNTS[0]) | path.startswith(MOUNTS[1]), F.lit(False))
