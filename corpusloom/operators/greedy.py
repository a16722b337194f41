"""Greedy packing of an array's elements in one pass, which collects index ranges instead of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators import passes

_FIELDS = ("first", "last", "from", "upto", "start_pos", "end_pos")
RANGE = f"array<struct<{','.join(f'{f}:int' for f in _FIELDS)}>>"


def ranges(sizes: str, most: int, overlap: int, joiner: int = 1, join_in_test: bool = False, cut: bool = True, join_in_size: bool = True) -> Column:
    """Ranges of elements by an SQL expression of their sizes: elements first to last, or with from >= 0 the slice of one element. None where it is null.

    A range is closed when the next element doesn't fit. The next one then starts with the longest run of
    whole elements at its end that is within the overlap. With ``cut``, an element over the maximum closes the
    range, is sliced by itself and carries no overlap on. ``joiner`` is the length of what joins elements;
    ``join_in_test`` counts it with the element in the test, ``join_in_size`` in the running size.
    """
    step = joiner if join_in_size else 0
    extra = joiner if join_in_test else 0

    def one(sizes: list[int] | None) -> list[tuple] | None:
        if sizes is None:
            return None
        out, first, size, pos = [], 0, 0, 0
        for i, n in enumerate(sizes):
            is_open = first < i
            if cut and n > most:
                if is_open:
                    out.append((first, i - 1, -1, -1, pos - size, pos))
                for a in range(0, n, most):
                    b = min(a + most, n)
                    out.append((i, i, a, b, a, b))
                first, size = i + 1, 0
            elif is_open and size + n + extra > most:
                out.append((first, i - 1, -1, -1, pos - size, pos))
                # back to the least index from which the elements up to i - 1 are within the overlap
                span, start, first = 0, first, i
                while first > start and span + sizes[first - 1] + (i - first) * step <= overlap:
                    first -= 1
                    span += sizes[first]
                size = span + (i - first) * step + n + extra
            else:
                size += n + extra + (step - extra * join_in_size if is_open else 0)
            pos += n + joiner
        if first < len(sizes):
            out.append((first, len(sizes) - 1, -1, -1, pos - size, pos))
        return out

    return passes.row_wise(one, RANGE, pa.list_(pa.struct([(f, pa.int32()) for f in _FIELDS])))(F.expr(sizes))


def pieces(elements: str, found: str, joiner: str = "\\n", **more: str) -> Column:
    """Text of each range of elements, as structs with the range's positions, and with more fields by SQL expressions of the range r."""
    text = f"CASE WHEN r.from >= 0 THEN substring({elements}[r.first], r.from + 1, r.upto - r.from) ELSE array_join(slice({elements}, r.first + 1, r.last - r.first + 1), '{joiner}') END"
    other = "".join(f", '{k}', {v}" for k, v in more.items())
    return F.expr(f"transform({found}, r -> named_struct('content', {text}, 'start_pos', r.start_pos, 'end_pos', r.end_pos, 'first', r.first, 'last', r.last{other}))")
