"""Helpers for writing oracle SQL."""

from __future__ import annotations

import re


def blank_trim(sql: str) -> str:
    """``sql`` with every one-argument ``trim(x)`` as ``trim(x, ' ')``: Spark trims blanks only, DuckDB all Unicode spaces."""
    out, at = [], 0
    for found in re.finditer(r"(?<![A-Za-z_])trim\(", sql):
        depth, stop, quoted, comma = 1, found.end(), False, False
        while depth:
            c = sql[stop]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                comma |= c == "," and depth == 1
            stop += 1
        if not comma:
            out.append((stop - 1, ", ' '"))
    for place, text in sorted(out, reverse=True):
        sql = sql[:place] + text + sql[place:]
    return sql
