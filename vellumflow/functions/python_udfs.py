"""The few functions that have no built-in form, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings, lower case and stripped; null if one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio() for x, y in zip(a, b)], dtype="float64")


def _common(places: dict[str, int], full: int, other: str) -> int:
    """Length of the longest common subsequence (bit-parallel); matching blocks are one, so it bounds the sequence ratio."""
    row = full
    for c in other:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return (full ^ row).bit_count()


def nearest_titles(terms: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
    """``(scope, term, title, score)``: per term the best of all ``titles``: equal .. 1, same stem .. 0.90, else the sequence ratio; ties: the first.

    Exact: titles are tried by falling letter overlap, an upper bound of the ratio, until it is below the best score.
    """
    out = {"scope": [], "term": [], "title": [], "score": []}
    titles = titles.sort_values("title")
    names, stems = titles["title"].tolist(), titles["stem"].tolist()
    lows = [x.lower().strip() for x in names]
    long = np.array([len(x) for x in lows])
    letters: dict[str, np.ndarray] = {}
    for k, low in enumerate(lows):
        for c, n in Counter(low).items():
            if c not in letters:
                letters[c] = np.zeros(len(lows), np.int32)
            letters[c][k] = n
    for scope, term, stem in zip(terms["scope"], terms["term"], terms["stem"]):
        if not names:
            break
        low = term.lower().strip()
        shared = sum((np.minimum(letters[c], n) for c, n in Counter(low).items() if c in letters), np.zeros(len(lows), np.int64))
        bound = np.where(long + len(low) > 0, 2.0 * shared / np.maximum(long + len(low), 1), 1.0)
        same = [k for k, x in enumerate(stems) if stem and x == stem]
        bound[same] = np.maximum(bound[same], 0.90)
        places: dict[str, int] = {}
        for at, c in enumerate(low):
            places[c] = places.get(c, 0) | (1 << at)
        best, first = -1.0, len(names)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < best:
                break
            if lows[k] == low:
                score = 1.0
            elif stem and stems[k] == stem:
                score = 0.90
            elif 2.0 * _common(places, (1 << len(low)) - 1, lows[k]) / (len(low) + long[k]) < best:
                continue
            else:
                score = difflib.SequenceMatcher(None, low, lows[k]).ratio()
            if score > best or (score == best and k < first):
                best, first = score, k
        for name, value in zip(out, (scope, term, names[first], best)):
            out[name].append(value)
    kinds = {"scope": terms["scope"].dtype, "term": object, "title": object, "score": "float64"}  # typed, as a part may be empty
    return pd.DataFrame({name: pd.Series(values, dtype=kinds[name]) for name, values in out.items()})


def _plain(value: object) -> str:
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def yaml_fields(blocks: pd.Series) -> pd.Series:
    """Top-level fields of a YAML block as text: dates in ISO form, lists as JSON-like text; invalid YAML gives no fields."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def fields(block: str | None) -> dict[str, str]:
        if not block:
            return {}
        if yaml is None:
            return {k.strip(): v.strip() for k, v in re.findall(r"(?m)^([\w-]+):[ \t]*(\S.*)$", block)}
        try:
            data = yaml.safe_load(block)
        except Exception:  # any malformed block
            return {}
        if not isinstance(data, dict):
            return {}
        return {str(k): ", ".join(map(_plain, v)) if isinstance(v, list) else _plain(v) for k, v in data.items() if v is not None}

    return blocks.map(fields)
