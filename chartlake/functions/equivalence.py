"""Guard equivalence (E6), condition keys and branch overlap (L4).

A condition (``' AND '`` of canonical guards, each ``' or '`` of ``' and '`` atoms) is a function of its
variables. For every variable the numbers it is compared with cut the number line into regions in which no atom
changes: integers need c-1, c, c+1; where a decimal occurs, c and the middles between; strings need each string
and one other; a bare variable needs 0 and 1 beside. The condition is evaluated at one point of every region at
once, as an array with one axis a variable. Equal arrays mean equal conditions.

``condition_keys`` turns that into a key: axes along which nothing changes are dropped, neighbouring regions that
agree are merged, and what is left (cuts and truth values) is the same for all ways to write a condition. So
equivalence is an equi-join on the key, without pairs.

A comparison of two variables is one more axis (less, equal, greater). That is sound for "equivalent by key";
``guard_equivalent`` then says ``not_refuted``. What cannot be decided is ``unknown`` with a reason: ``unparsable``,
``types`` (a variable compared with both numbers and strings) or ``size`` (more than ``POINTS`` regions).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Regions evaluated for one condition or pair at most; beyond, the verdict is ``unknown`` for the reason ``size``.
POINTS = 1 << 18
_NUM = re.compile(r"^-?[0-9]+(\.[0-9]+)?$")
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")
_STR = re.compile(r"^('[^']*'|\"[^\"]*\")$")
_ATOM = re.compile(r"^(not )?(\S+)(?: (==|!=|>=|<=|>|<) (.+))?$")
_OPS = {"==": np.equal, "!=": np.not_equal, ">=": np.greater_equal, "<=": np.less_equal, ">": np.greater, "<": np.less}
_TURN = {"==": "==", "!=": "!=", ">=": "<=", "<=": ">=", ">": "<", "<": ">"}


class Unknown(Exception):
    """A condition that cannot be decided; the reason is its text."""


def parse_cond(cond: str | None) -> list[list[list[tuple]]]:
    """AND of OR of AND of atoms ``(negated, variable, op, kind, value)``; ``[]`` for true."""
    if cond is None:
        raise Unknown("unparsable")
    out = []
    for g in cond.split(" AND "):
        if g == "true":
            continue
        out.append([[_atom(a) for a in c.split(" and ")] for c in g.split(" or ")])
    return out


def _atom(text: str) -> tuple:
    m = _ATOM.match(text)
    if not m or not _IDENT.match(m.group(2)):
        raise Unknown("unparsable")
    neg, var, op, val = bool(m.group(1)), m.group(2), m.group(3) or "", m.group(4) or ""
    if not op:
        return neg, var, "", "bare", ""
    if _NUM.match(val):
        return neg, var, op, "num", Fraction(val)
    if _STR.match(val):
        if op not in ("==", "!="):
            raise Unknown("types")
        return neg, var, op, "str", val[1:-1]
    if _IDENT.match(val) and val not in ("true", "false"):
        # one axis for both ways to write the comparison
        return (neg, f"{val}?{var}", _TURN[op], "rel", "") if val < var else (neg, f"{var}?{val}", op, "rel", "")
    raise Unknown("unparsable")


def _axes(atoms: list[tuple]) -> dict[str, list]:
    """Points of every variable in order; numbers are Fractions, a point after a decimal c is (c, 1)."""
    use: dict[str, dict] = {}
    for _, var, _, kind, val in atoms:
        use.setdefault(var, {}).setdefault(kind, set()).add(val)
    out: dict[str, list] = {}
    for var in sorted(use):
        kinds = use[var]
        if "rel" in kinds:
            out[var] = [Fraction(-1), Fraction(0), Fraction(1)]
        elif "str" in kinds:
            if "num" in kinds or "bare" in kinds:
                raise Unknown("types")
            out[var] = [*sorted(kinds["str"]), None]
        elif "num" not in kinds:
            out[var] = [Fraction(0), Fraction(1)]
        else:
            cuts = sorted(kinds["num"] | ({Fraction(0)} if "bare" in kinds else set()))
            if all(c.denominator == 1 for c in cuts):
                out[var] = sorted({c + d for c in cuts for d in (-1, 0, 1)})
            else:
                middles = [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]
                out[var] = sorted([*cuts, *middles, cuts[0] - 1, cuts[-1] + 1])
    size = 1
    for p in out.values():
        size *= len(p)
    if size > POINTS:
        raise Unknown("size")
    return out


def _truth(terms, axes: dict[str, list]) -> np.ndarray:
    """Truth values at all points, one axis a variable."""
    names = list(axes)
    shape = tuple(len(axes[v]) for v in names)

    def atom(a) -> np.ndarray:
        neg, var, op, kind, val = a
        points = axes[var]
        if kind == "bare":
            t = np.array([p != 0 for p in points])
        elif kind == "str":
            t = np.array([(p == val) == (op == "==") for p in points])
        else:
            t = np.array([bool(_OPS[op](p, Fraction(0) if kind == "rel" else val)) for p in points])
        t = ~t if neg else t
        return t.reshape([len(points) if v == var else 1 for v in names])

    out = np.ones(shape, bool)
    for g in terms:
        group = np.zeros(shape, bool)
        for c in g:
            clause = np.ones(shape, bool)
            for a in c:
                clause = clause & atom(a)
            group |= clause
        out &= group
    return out


def _atoms(terms) -> list[tuple]:
    return [a for g in terms for c in g for a in c]


def condition_key(cond: str | None) -> tuple[str | None, str | None]:
    """(key, reason): equal keys mean equivalent conditions. Where the reason is ``size`` or ``types`` the key is the text
    itself, so that equal texts still match; an unparsable condition has no key."""
    try:
        terms = parse_cond(cond)
        axes = _axes(_atoms(terms))
        t = _truth(terms, axes)
    except Unknown as e:
        return (None if str(e) == "unparsable" else f"text:{cond}"), str(e)
    parts = []
    for k, (var, points) in reversed(list(enumerate(axes.items()))):
        rows = np.moveaxis(t, k, 0)
        if points[-1] is None:  # strings that act like any other one are dropped
            keep = [i for i in range(len(points) - 1) if (rows[i] != rows[-1]).any()] + [len(points) - 1]
            names = [repr(points[i]) for i in keep[:-1]]
        else:
            keep = [0] + [i for i in range(1, len(points)) if (rows[i] != rows[i - 1]).any()]
            decimal = any(p.denominator != 1 for p in points)
            # a region begins at a number or, where decimals occur, just after the number before it
            names = [f"{points[i]}" if not decimal or (i % 2 == 1) else f">{points[i - 1]}" for i in keep[1:]]
        t = np.take(t, keep, axis=k)
        if len(keep) == 1:
            t = np.squeeze(t, axis=k)
        else:
            parts.append(f"{var}:{','.join(names)}")
    if not parts:
        return ("true" if bool(t) else "false"), None
    bits = "".join("1" if x else "0" for x in t.reshape(-1))
    text = ";".join(reversed(parts)) + "|" + bits
    return (text if len(text) <= 200 else "md5:" + hashlib.md5(text.encode()).hexdigest()), None


def equivalence_verdict(c1: str | None, c2: str | None) -> tuple[str, int | None, str | None]:
    """(verdict, points evaluated, reason of ``unknown``)."""
    try:
        t1, t2 = parse_cond(c1), parse_cond(c2)
        atoms = _atoms(t1) + _atoms(t2)
        axes = _axes(atoms)
        a, b = _truth(t1, axes), _truth(t2, axes)
    except Unknown as e:
        return "unknown", None, str(e)
    n = int(np.prod([len(p) for p in axes.values()], dtype=np.int64))
    related = any(x[3] == "rel" for x in atoms)
    if (a == b).all():
        return ("not_refuted" if related else "equivalent"), n, None
    # with two compared variables a difference may lie where the comparisons contradict each other
    mixed = related and len({x[1] for x in atoms}) > 1
    return ("unknown", n, "related") if mixed else ("different", n, None)


def overlap_of(conds) -> tuple[bool | None, str | None]:
    """(overlap, reason): whether two of the conditions hold together somewhere; None with a reason if that is not known."""
    truths, reason = [], None
    terms = []
    for c in conds:
        try:
            terms.append(parse_cond(c))
        except Unknown as e:
            reason = str(e)
    try:
        axes = _axes([a for t in terms for a in _atoms(t)])
        truths = [_truth(t, axes) for t in terms]
    except Unknown as e:
        # too many regions together: pair by pair, each with its own axes
        reason = str(e) if str(e) != "size" else reason
        for i, x in enumerate(terms):
            for y in terms[:i]:
                try:
                    axes = _axes(_atoms(x) + _atoms(y))
                    if (_truth(x, axes) & _truth(y, axes)).any():
                        return True, None
                except Unknown as e2:
                    reason = str(e2)
        return (None, reason) if reason else (False, None)
    if len(truths) > 1 and (np.sum([t.astype(np.int32) for t in truths], axis=0) >= 2).any():
        return True, None
    return (None, reason) if reason else (False, None)


def condition_keys(conds: DataFrame, col: str = "cond_key") -> DataFrame:
    """``(col, cond_sem, cond_reason)`` of the distinct conditions of a table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [condition_key(x) for x in b[col]]
            yield pd.DataFrame({col: b[col], "cond_sem": [g[0] for g in got], "cond_reason": [g[1] for g in got]})

    return conds.select(col).distinct().mapInPandas(run, f"{col} string, cond_sem string, cond_reason string")


def guard_equivalent(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """Adds ``verdict`` (equivalent / different / not_refuted / unknown), ``grid_points`` and ``reason``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = [equivalence_verdict(x, y) for x, y in zip(b["_c1"], b["_c2"])]
            yield pd.DataFrame({"_c1": b["_c1"], "_c2": b["_c2"], "verdict": [r[0] for r in res],
                                "grid_points": pd.array([r[1] for r in res], dtype="Int64"), "reason": [r[2] for r in res]})

    keys = df.select(F.col(c1).alias("_c1"), F.col(c2).alias("_c2")).distinct()
    v = keys.mapInPandas(run, "_c1 string, _c2 string, verdict string, grid_points bigint, reason string")
    cond = F.col(c1).eqNullSafe(v["_c1"]) & F.col(c2).eqNullSafe(v["_c2"])
    return df.join(v, cond).drop("_c1", "_c2")


def branch_overlap(df: DataFrame, conds: str) -> DataFrame:
    """Adds ``overlap`` (NULL where it is not known) and ``reason`` for the array column ``conds``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [overlap_of(list(x)) for x in b["_k"]]
            yield pd.DataFrame({"_k": b["_k"], "overlap": pd.array([g[0] for g in got], dtype="boolean"),
                                "reason": [g[1] for g in got]})

    keyed = df.withColumn("_k", F.array_sort(F.coalesce(F.col(conds), F.expr("cast(array() as array<string>)"))))
    v = keyed.select("_k").distinct().mapInPandas(run, "_k array<string>, overlap boolean, reason string")
    return keyed.join(v, "_k").drop("_k")
