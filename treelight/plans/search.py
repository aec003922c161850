"""Compiles a query into a DataFrame plan: filters on folded names, then on paths if asked for, then order and page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.functions.fold import fold, is_wildcard, matches
from treelight.operators.paths import with_paths
from treelight.plans.query import Query, parse

SORTS = ("none", "name", "path")
DEFAULT_LIMIT, MOST_LIMIT = 100, 1000


@dataclass
class Options:
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    sort: str = "none"
    match_path: bool = False


def clamp_limit(limit: int, most: int = MOST_LIMIT) -> int:
    return max(1, min(limit, most))


def _cost(pattern: str) -> tuple[bool, int]:
    """Plain text before wildcards, long (selective) before short; the order doesn't change the result."""
    return is_wildcard(pattern), -len(pattern)


def _all(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (matches(column, p) for p in sorted(patterns, key=_cost)), F.lit(True))


def matched(entries: DataFrame, paths: DataFrame, query: Query | str, options: Options | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """All live entries that match, with path where it was needed to decide or to sort.

    Names are filtered before paths are joined; without a path term or sort=path there's no join at all.
    volumes (drive, phase) restricts the search to those that are ready.
    """
    query, options = parse(query) if isinstance(query, str) else query, options or Options()
    name_terms, path_terms = ([], query.terms + query.path_terms) if options.match_path else (query.terms, query.path_terms)
    rows = entries.where("not deleted")
    if query.drives:
        rows = rows.where(F.lower("drive").isin(sorted(set(query.drives))))
    if volumes is not None:
        rows = rows.join(volumes.where("phase = 'ready'").select("drive"), "drive", "left_semi")
    if name_terms:
        rows = rows.where(_all(F.col("name_fold"), name_terms))
    if path_terms or options.sort == "path":
        rows = with_paths(rows, paths)
        if path_terms:
            rows = rows.where(_all(fold(F.col("path")), path_terms))
    return rows


def page(entries: DataFrame, paths: DataFrame, query: Query | str, options: Options | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """One page of hits in order: drive, slot, name, path, is_dir. Paths are joined to the page alone unless they decide or sort."""
    options = options or Options()
    rows = matched(entries, paths, query, options, volumes)
    order = {"name": ["name", "drive", "slot"], "path": ["path", "drive", "slot"]}.get(options.sort, ["drive", "slot"])
    rows = rows.orderBy(*order).offset(max(0, options.offset)).limit(clamp_limit(options.limit))
    if "path" not in rows.columns:
        rows = with_paths(F.broadcast(rows), paths).orderBy(*order)  # at most MOST_LIMIT rows
    return rows.select("drive", "slot", "name", "path", "is_dir")


def totals(entries: DataFrame, paths: DataFrame, query: Query | str, options: Options | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """One row: total_matched and non_dir_matched, of all matches before paging."""
    rows = matched(entries, paths, query, options, volumes)
    return rows.agg(F.count(F.lit(1)).alias("total_matched"), F.count_if(~F.col("is_dir")).alias("non_dir_matched"))
