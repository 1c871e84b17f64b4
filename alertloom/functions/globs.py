"""Patterns of configuration as column predicates: globs, and the match language of detection rules."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(c: Column, pattern: str, fold: bool = True) -> Column:
    """Whether a text matches a shell pattern; translated once, on the driver."""
    body = fnmatch.translate(pattern.lower() if fold else pattern).replace("\\Z", "").replace("\\z", "").removeprefix("(?s:").removesuffix(")")
    return (F.lower(c) if fold else c).rlike(f"(?s)^(?:{body})$")


def any_glob(c: Column, patterns: Sequence[str], fold: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob(c, p, fold)
    return out


def tier(host: Column, critical: Sequence[str] = (), low: Sequence[str] = ()) -> Column:
    """critical, low or standard; critical patterns come first."""
    return F.when(any_glob(host, critical), "critical").when(any_glob(host, low), "low").otherwise("standard")


def os_match(c: Column, pattern: str) -> Column:
    """Substrings in any case, alternatives by |, ^ and $ at the ends, ! in front for the contrary."""
    negate = pattern.startswith("!")
    items = []
    for p in pattern.removeprefix("!").split("|"):
        head, tail = p.startswith("^"), p.endswith("$")
        core = re.escape(p[1 if head else 0 : len(p) - 1 if tail else len(p)])
        items.append(("^" if head else "") + core + ("$" if tail else ""))
    hit = c.rlike("(?is)" + "|".join(items))
    return ~hit if negate else hit
