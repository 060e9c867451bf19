"""Distances between two records as Columns: per attribute, then aggregated."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.transform import clean_tokens, haversine_km


def categorical(a: Column, b: Column, cardinality: int | None = None) -> Column:
    """0 for equal values, else 1, or sqrt(2) / cardinality if given."""
    return F.when(a == b, 0.0).otherwise(F.lit(2**0.5 / cardinality if cardinality else 1.0))


def set_inclusion(a: Column, b: Column) -> Column:
    """The share of a's elements (arrays) that b lacks."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_except(a, b)) / F.size(F.array_distinct(a)))


def numeric(a: Column, b: Column, scale: float, lower: float | None = None, upper: float | None = None) -> Column:
    """|a - b| / scale; above ``upper`` it is 1, below ``lower`` 0."""
    d = F.abs(a - b) / F.lit(float(scale))
    out = F.when(d > upper, 1.0).otherwise(d) if upper is not None else d
    return F.when(d < lower, 0.0).otherwise(out) if lower is not None else out


def geo(a: Column, b: Column, most_km: float) -> Column:
    """Great circle distance of structs with lat and lon, as a share of the largest expected."""
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) / most_km


def jaccard(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    """1 - m / (m + wa * only in a + wb * only in b) over token sets; 0 for two empty sets."""
    m = F.size(F.array_intersect(a, b))
    rest = weight_a * F.size(F.array_except(a, b)) + weight_b * F.size(F.array_except(b, a))
    return F.when(m + rest == 0, 0.0).otherwise(1 - m / (m + rest))


def dice(a: Column, b: Column) -> Column:
    """1 - 2 m / (|a| + |b|) over token sets; 0 for two empty sets."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 0.0).otherwise(1 - 2 * F.size(F.array_intersect(a, b)) / total)


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2))))


def character_pairs(a: Column, b: Column) -> Column:
    """Dice distance over the sets of adjacent character pairs."""
    return dice(F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b)))


def cosine(a: Column, b: Column, count: bool = True) -> Column:
    """1 - cosine of the term vectors, by counts or presence; 1 if one of them is empty."""
    terms = F.array_union(a, b)
    tally = lambda words, t: F.size(F.filter(words, lambda w: w == t)) if count else F.array_contains(words, t).cast("int")
    dot = F.aggregate(terms, F.lit(0.0), lambda s, t: s + tally(a, t) * tally(b, t))
    norm = lambda words: F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + tally(words, t) * tally(words, t)))
    both = norm(a) * norm(b)
    return F.when(both == 0, 1.0).otherwise(1 - dot / both)


TEXT = {"jaccard": jaccard, "dice": dice, "cosine": cosine}


def text(a: Column, b: Column, strategy: str, **options) -> Column:
    return character_pairs(a, b) if strategy == "charPair" else TEXT[strategy](clean_tokens(a), clean_tokens(b), **options)


def _of_vectors(kind: str):
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        sizes = np.array([-1 if x is None or y is None or len(x) != len(y) else len(x) for x, y in zip(a, b, strict=True)])
        for n in np.unique(sizes[sizes >= 0]):
            rows = np.flatnonzero(sizes == n)
            x, y = (np.stack(s.to_numpy()[rows]).astype(float) if n else np.zeros((len(rows), 0)) for s in (a, b))
            if kind == "manhattan":
                out[rows] = np.abs(x - y).sum(1)
            elif kind == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[rows] = 1 - (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            else:
                out[rows] = np.sqrt(((x - y) ** 2).sum(1))
        return pd.Series(out).where(~np.isnan(out), None)

    return distance


def vector(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """Between arrays of numbers: euclidean, manhattan or cosine (1 - similarity). Null for nulls, unequal lengths and,
    by cosine, zero vectors. In Arrow batches, as interpreted lambdas over long arrays are far slower."""
    return _of_vectors(kind)(a.cast("array<double>"), b.cast("array<double>"))


def aggregate(distances: Sequence[Column], kind: str = "euclidean", power: float = 3.0) -> Column:
    """euclidean: the root of the sum of squares, divided by n; manhattan: the mean; minkowski; categorical: the mean."""
    n, total = len(distances), lambda xs: reduce(lambda a, b: a + b, xs)
    if kind == "euclidean":
        return F.sqrt(total([d * d for d in distances])) / n
    if kind == "minkowski":
        return F.pow(total([F.pow(d, F.lit(power)) for d in distances]) / n, F.lit(1 / power))
    return total(list(distances)) / n


@dataclass(frozen=True)
class Part:
    """One attribute's distance: kind numeric, categorical, geo, text, vector or setInclusion, with its options and weight."""

    name: str
    kind: str
    weight: float = 1.0
    options: dict | None = None


def prepared(p: Part) -> Column:
    """The attribute of a part as the comparison of pairs wants it: texts as tokens, or as their distinct character pairs."""
    if p.kind != "text":
        return F.col(p.name)
    return F.array_distinct(bigrams(F.col(p.name))) if (p.options or {}).get("strategy") == "charPair" else clean_tokens(F.col(p.name))


def value_difference(a: Column, b: Column, table: dict[tuple[str, str], float]) -> Column:
    """The looked-up distance of two categories, in either order; 0 for equal ones, 1 for pairs that the table lacks.

    ``table`` becomes part of the plan, so it is held to 10,000 pairs; it is made of the value difference metric of the
    categories (``categorical_value_difference``).
    """
    if len(table) > 10_000:
        raise ValueError("more than 10,000 pairs of categories")
    pairs = [x for (u, v), d in table.items() for x in (F.lit("\x00".join(sorted((u, v)))), F.lit(float(d)))]
    x, y = a.cast("string"), b.cast("string")
    found = F.create_map(*pairs)[F.concat_ws("\x00", F.least(x, y), F.greatest(x, y))] if pairs else F.lit(None).cast("double")
    return F.when(x == y, 0.0).when(x.isNotNull() & y.isNotNull(), F.coalesce(found, F.lit(1.0)))


KINDS = {"valueDifference": value_difference, "numeric": numeric, "categorical": categorical, "geo": geo, "text": text, "vector": vector, "setInclusion": set_inclusion}


def _compare(p: Part):
    options = dict(p.options or {})
    if p.kind == "text":
        of_tokens = TEXT["dice" if (how := options.pop("strategy")) == "charPair" else how]
        return lambda a, b: of_tokens(a, b, **options)
    return lambda a, b: KINDS[p.kind](a, b, **options)


class TokenMatrix:
    """Distances of a text part between the token lists ``a`` and ``b``, from the product of their term matrices.

    The product has each pair's number of shared tokens (cosine by counts: the sum of products) in floats that hold it
    exactly; terms are taken some columns at a time, and only those that both sides have.
    """

    CELLS = 2_000_000

    def __init__(self, p: Part, a: pa.Array, b: pa.Array):
        self.options = dict(p.options or {})
        self.how = self.options.pop("strategy")
        self.counted = self.how == "cosine" and self.options.get("count", True)
        lists = [a, b]
        lengths = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        terms = max(1, len(codes.dictionary))
        codes = np.split(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), [lengths[0].sum()])
        self.null = [x.is_null().to_numpy(zero_copy_only=False) for x in lists]
        self.size, cells = [], []
        for n, c in zip(lengths, codes, strict=True):
            cell, count = np.unique(np.repeat(np.arange(len(n)), n) * terms + c, return_counts=True)
            row, count = cell // terms, count if self.counted else np.ones_like(count)
            self.size.append(np.bincount(row, weights=count.astype(float) ** 2, minlength=len(n)))  # of presence: distinct tokens
            cells.append((row, cell % terms, count))
        shared = np.intersect1d(cells[0][1], cells[1][1])
        self.cells = [(row[at], np.searchsorted(shared, c[at]), count[at]) for row, c, count in cells for at in [np.isin(c, shared)]]
        most = [max(n, default=0) for n in lengths]
        self.float = np.float32 if most[0] * most[1] < 2**24 else np.float64
        width = max(64, self.CELLS // max(1, len(lengths[1])))
        self.columns = [(v, min(v + width, len(shared))) for v in range(0, len(shared), width)]
        self.kept = self._terms(1, 0, len(lengths[1]), *self.columns[0]) if len(self.columns) == 1 else None

    def _terms(self, side: int, start: int, stop: int, v: int, w: int) -> np.ndarray:
        row, code, count = self.cells[side]
        lo, hi = np.searchsorted(row, [start, stop])
        at = slice(lo, hi) if len(self.columns) == 1 else lo + np.flatnonzero((code[lo:hi] >= v) & (code[lo:hi] < w))
        x = np.zeros((stop - start, w - v), self.float)
        x[row[at] - start, code[at] - v] = count[at]
        return x

    def shared(self, start: int, stop: int, first: int) -> np.ndarray:
        """Of the rows ``start`` to ``stop`` of a with those of b from ``first`` on."""
        n = len(self.null[1])
        out = np.zeros((stop - start, n - first), self.float)
        for v, w in self.columns:
            y = self.kept[first:] if self.kept is not None else self._terms(1, first, n, v, w)
            out += self._terms(0, start, stop, v, w) @ y.T
        return out

    def distances(self, m: np.ndarray, i: np.ndarray, j: np.ndarray, turned: np.ndarray | None = None) -> pa.Array:
        """Of the pairs (i, j) that share m; ``turned``: pairs whose first record is j."""
        m, a, b = m.astype(float), self.size[0][i], self.size[1][j]
        if turned is not None:
            a, b = np.where(turned, b, a), np.where(turned, a, b)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.how == "cosine":
                both = np.sqrt(a) * np.sqrt(b)
                d = np.where(both == 0, 1.0, 1 - m / both)
            elif self.how == "jaccard":
                total = m + (self.options.get("weight_a", 1.0) * (a - m) + self.options.get("weight_b", 1.0) * (b - m))
                d = np.where(total == 0, 0.0, 1 - m / total)
            else:
                d = np.where(a + b == 0, 0.0, 1 - 2 * m / (a + b))
        none = self.null[0][i] | self.null[1][j] if self.null[0].any() or self.null[1].any() else None
        return pa.array(d, mask=none)


def record_distance(left: str, right: str, parts: Sequence[Part], how: str = "weighted", missing: float | None = None, given: dict[int, Column] | None = None) -> Column:
    """Distance of the structs ``left`` and ``right`` (of ``prepared`` attributes): the weighted mean of the parts, or an aggregate of them by ``how``.

    ``missing``: the distance where a value is null; without it, such parts are left out of the weighted mean. ``given``:
    distances of parts, by their place, that are known.
    """
    given = given or {}
    ds = [(p.weight, given[i] if i in given else _compare(p)(F.col(f"{left}.{p.name}"), F.col(f"{right}.{p.name}"))) for i, p in enumerate(parts)]
    if missing is not None:
        ds = [(w, F.coalesce(d, F.lit(float(missing)))) for w, d in ds]
    if how != "weighted":
        return aggregate([d for _, d in ds], how)
    top = reduce(lambda a, b: a + b, [F.coalesce(w * d, F.lit(0.0)) for w, d in ds])
    weight = reduce(lambda a, b: a + b, [F.when(d.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, d in ds])
    return F.when(weight > 0, top / weight)
