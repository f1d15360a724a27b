"""Similarity of two names by their sets of words, without Python.

Words that both names have, and those that only one has, are each sorted and joined. The result is the best ratio
among: the two differences (with the common words in front), and the common words against each full side. The ratio
of two texts is 1 - d / (sum of lengths), d being the least number of insertions and deletions between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters a 64-bit number stands for; the rest leaves room for the carry of an addition.
BLOCK = 60


def _mask(marked: str, char: str) -> str:
    """SQL for the bits of the marked characters (structs of c and bit) that equal char."""
    return f"aggregate({marked}, 0L, (m, e) -> CASE WHEN e.c = {char} THEN m | e.bit ELSE m END)"


def _common_subsequence(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence of two SQL strings.

    A row of the table of lengths is kept as its steps, a bit for each character of a, cleared where the length goes
    up; a character of b then costs an addition for each BLOCK characters of a (Hyyro, 2004).
    """
    mark = "(x, n) -> named_struct('c', x, 'bit', shiftleft(1L, n))"
    one = (
        f"transform(array(transform(split({a}, ''), {mark})), z -> size(z) - bit_count(aggregate(split({b}, ''), shiftleft(1L, size(z)) - 1, "
        f"(v, y) -> transform(array({_mask('z', 'y')}), k -> ((v + (v & k)) | (v & ~k)) & (shiftleft(1L, size(z)) - 1))[0])))[0]"
    )
    add = (
        f"(s, t) -> transform(array({_mask('t', 'y')}), k -> transform(array(v[size(s.row)]), u -> transform(array(u + (u & k) + s.carry), w -> "
        "named_struct('row', concat(s.row, array((w | (u & ~k)) & (shiftleft(1L, size(t)) - 1))), 'carry', shiftright(w, size(t))))[0])[0])[0]"
    )
    many = (
        f"transform(array(transform(sequence(0, (length({a}) - 1) DIV {BLOCK}), q -> transform(slice(split({a}, ''), int(q * {BLOCK} + 1), {BLOCK}), {mark}))), "
        f"z -> length({a}) - aggregate(aggregate(split({b}, ''), transform(z, t -> shiftleft(1L, size(t)) - 1), "
        f"(v, y) -> aggregate(z, named_struct('row', CAST(array() AS ARRAY<BIGINT>), 'carry', 0L), {add}).row), 0, (n, v) -> n + bit_count(v)))[0]"
    )
    return f"CASE WHEN length({a}) <= {BLOCK} THEN {one} ELSE {many} END"


def token_set_ratio(left: str, right: str) -> Column:
    """0 to 1 for two columns of normalised names, given by name; 0 if either has no words."""
    body = f"""
      CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D
           WHEN size(i) > 0 AND (da = '' OR db = '') THEN 1D
           WHEN least_d_ratio <= with_common THEN with_common
           ELSE greatest(with_common, 1 - (length(da) + length(db) - 2 * {_common_subsequence('da', 'db')}) / total) END
    """
    # names are bound through one-element arrays, so each is computed once
    bind = [
        ("a", "array_sort(array_distinct(filter(split(l, ' '), w -> w <> '')))"),
        ("b", "array_sort(array_distinct(filter(split(r, ' '), w -> w <> '')))"),
        ("i", "array_intersect(a, b)"),
        ("da", "array_join(array_except(a, b), ' ')"),
        ("db", "array_join(array_except(b, a), ' ')"),
        ("s", "length(array_join(i, ' '))"),
        ("sep", "CASE WHEN s > 0 THEN 1 ELSE 0 END"),
        ("total", "CAST(greatest(2 * (s + sep) + length(da) + length(db), 1) AS DOUBLE)"),
        ("with_common", "CASE WHEN s = 0 THEN 0D ELSE greatest(1 - CAST(sep + length(da) AS DOUBLE) / (2 * s + sep + length(da)), 1 - CAST(sep + length(db) AS DOUBLE) / (2 * s + sep + length(db))) END"),
        ("least_d_ratio", "1 - abs(length(da) - length(db)) / total"),
    ]
    expr = body
    for name, value in reversed(bind):
        expr = f"transform(array({value}), {name} -> {expr})[0]"
    return F.expr(f"transform(array(coalesce({left}, '')), l -> transform(array(coalesce({right}, '')), r -> {expr})[0])[0]")
