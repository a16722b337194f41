"""Passes over a row's arrays in Python, for what native folds can't do in linear time: they copy their whole state, with all that it has collected, for each element."""

# What runs on workers is defined within functions, so that it is sent along and workers needn't find this package.

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are held as Python values before they become Arrow ones.
HELD = 100_000


def row_wise(one: Callable[..., list | None], returns: str, kind: pa.DataType) -> Callable[..., Column]:
    """A function of columns from one of a row's values, which gives a list; only a few rows' values are held at a time.

    A list of structs comes as a list for each field. Texts should come and go as bytes, as not all need be valid UTF-8.
    """
    held = HELD

    def value(v: pa.Scalar) -> Any:
        if not isinstance(v, pa.ListScalar) or v.values is None:
            return v.as_py()
        return [c.to_pylist() for c in v.values.flatten()] if pa.types.is_struct(v.type.value_type) else v.values.to_pylist()

    def run(*columns: pa.Array) -> pa.Array:
        done, rows, size = [], [], 0
        for values in zip(*columns):
            rows.append(one(*map(value, values)))
            size += 1 + len(rows[-1] or ())
            if size >= held:
                done.append(pa.array(rows, kind))
                rows, size = [], 0
        return pa.concat_arrays([*done, pa.array(rows, kind)])

    return F.arrow_udf(run, returns)


def _parser(caption_lines: int) -> Callable:
    """What finds the sections of a document's classified lines: the end of its preamble, ``heads`` and the section of each line.

    A head is (line, number, title, level, parent, last line of a table). After the preamble's, if there is one, they are in order.
    """

    def parse(line: list[bytes], kind: list[bytes], number: list[bytes], n: list[bytes], title: list[bytes], dotted: list[bool], numbered: list[bool], verb: list[bool], caption: list[bytes]) -> tuple[int, list[tuple], list[int]]:
        many, paragraph, numbers = len(line), b"paragraph", (b"simple", b"multi_level")
        # lines before the cut are the preamble: it ends at the last number before the first line with a verb, else at the first number
        marks = [i for i, x in enumerate(numbered) if x]
        if True in verb:
            cut = max((i for i in marks if i < verb.index(True)), default=0)
        else:
            cut = marks[0] if marks else 0
        fences = [i for i, x in enumerate(line) if x.startswith(b"```")]
        heads: list[tuple] = []
        stack: list[tuple[bytes, int, int]] = []
        copies: dict[bytes, int] = {}
        # upper is whether "1." has opened the numbering: the highest number seen at that place never changes afterwards
        first, upper, listing, last, busy = True, False, False, None, 0
        for i in range(many):
            if busy > i:
                continue
            if caption[i] is not None and stack:
                opened = next((k for k in range(i + 1, min(i + 2 + caption_lines, many)) if line[k].startswith(b"```json")), None)
                if opened is not None and fences[-1] > opened:
                    upto = fences[bisect(fences, opened)]
                    name = [x for x in line[i + 1 : opened] if not x.startswith(b"```")][:1]
                    above, level, place = stack[-1]
                    heads.append((i, above + b".T" + caption[i], " — ".encode().join([line[i], *name]), level + 1, place, upto))
                    busy = upto + 1
                    continue
            if i < cut or kind[i] not in numbers:
                continue
            if kind[i] == b"simple":
                value = None if n[i] is None else int(n[i])
                opens = first and value == 1
                if value is None or (not opens and (listing or (last is not None and value > last) or not upper or value == 1)):
                    listing, last = True, value
                    continue
                first, upper, listing = first and not opens, upper or opens, False
            elif dotted[i]:
                listing = False
            told = number[i]
            if stack and stack[-1][0] == told:
                # a repeated number opens a section below the first one's
                _, above, parent = stack[-1]
                copies[told] = copies.get(told, 0) + 1
                told, level = b"%s.%d" % (told, copies[told]), above + 1
            else:
                level = told.count(b".") + 1
                while stack and stack[-1][1] >= level:
                    stack.pop()
                parent = stack[-1][2] if stack else None
            stack.append((told, level, len(heads)))
            heads.append((i, told, title[i], level, parent, None))
        # preamble: lines before the cut, then paragraphs before the first section; a list ahead of both has no section
        start = heads[0][0] if heads else many
        zero = next((i for i in range(start) if i < cut or kind[i] == paragraph), None)
        owners = [-1 if zero is None or i < zero else 0 for i in range(start)]
        if zero is not None:
            heads = [(zero, b"0", line[zero], 0, None, None), *((i, x, t, level, None if up is None else up + 1, upto) for i, x, t, level, up, upto in heads)]
        # a line belongs to the table around it, else to the section opened last
        for k in range(0 if zero is None else 1, len(heads)):
            i, _, _, _, parent, upto = heads[k]
            until = heads[k + 1][0] if k + 1 < len(heads) else many
            owners += [k] * (until - i) if upto is None else [k] * (upto - i + 1) + [parent] * (until - upto - 1)
        return cut, heads, owners

    return parse


def owners(lines: Column, caption_lines: int) -> Column:
    """``owner, early`` for each line of a document: its section, or -1 for a list before any, and whether it is in the preamble."""
    parse = _parser(caption_lines)

    def one(lines: list[list]) -> list[tuple]:
        line, _, *told = lines
        cut, _, found = parse(line, *told)
        return [(k, i < cut) for i, k in enumerate(found)]

    return row_wise(one, "array<struct<owner:int,early:boolean>>", pa.list_(pa.struct([("owner", pa.int32()), ("early", pa.bool_())])))(lines)


def sections(lines: Column, caption_lines: int) -> Column:
    """The sections of a document, with texts as bytes."""
    parse = _parser(caption_lines)

    def one(lines: list[list]) -> list[tuple]:
        line, raw, *told = lines
        _, heads, held = parse(line, *told)
        own: list[list[int]] = [[] for _ in heads]
        for i, k in enumerate(held):
            if k >= 0:
                own[k].append(i)
        kids: list[list[int]] = [[] for _ in heads]
        for k, h in enumerate(heads):
            if h[4] is not None:
                kids[h[4]].append(k)
        lo: dict[bytes, int] = {}
        for i, x in enumerate(line):
            lo.setdefault(x, i)
        hi = {x: i for i, x in enumerate(line)}
        found = []
        for k, (at, number, title, level, parent, upto) in enumerate(heads):
            mine = own[k]
            if upto is not None:
                # of a table: its line, the first line of its own if the fence doesn't follow at once, and the fence
                fence = next((j for j, i in enumerate(mine) if j and line[i].startswith(b"```json")), len(mine))
                name = next((j for j, i in enumerate(mine) if j and not line[i].startswith(b"```")), -1) if fence > 1 else -1
                mine = [i for j, i in enumerate(mine) if not j or j >= fence or j == name]
                texts, shown = [line[i] for i in mine], [raw[i] for i in mine]
            elif level:
                # a heading is rendered without what followed its number in the text, and may then equal another line or none
                rest = [line[i] for i in mine if i > at]
                texts, shown = [number + (b". " + title if title else b"."), *rest], [number + b". " + title, *rest]
            else:
                texts = shown = [line[i] for i in mine]
            children = [heads[c][1] for c in kids[k]]
            tables = [heads[c][1] for c in kids[k] if heads[c][5] is not None]
            spots = [x for x in texts if x in lo]
            found.append((number, title, level, parent, None if parent is None else heads[parent][1], children, tables, b"\n".join(shown), min((lo[x] for x in spots), default=None), max((hi[x] for x in spots), default=None)))
        return found

    names = [("number", pa.binary()), ("title", pa.binary()), ("level", pa.int32()), ("parent_idx", pa.int32()), ("parent_number", pa.binary()), ("children", pa.list_(pa.binary())), ("tables", pa.list_(pa.binary())), ("content", pa.binary()), ("para_first", pa.int32()), ("para_last", pa.int32())]
    returns = "array<struct<number:binary,title:binary,level:int,parent_idx:int,parent_number:binary,children:array<binary>,tables:array<binary>,content:binary,para_first:int,para_last:int>>"
    return row_wise(one, returns, pa.list_(pa.struct(names)))(lines)


def paths(titles: Column, parents: Column) -> Column:
    """For each title the titles from the root down to it; a parent that doesn't come before its child counts as none."""

    def one(titles: list[Any], parents: list[int | None]) -> list[list]:
        found: list[list] = []
        for title, up in zip(titles, parents):
            found.append([*(found[up] if up is not None and 0 <= up < len(found) else ()), title])
        return found

    return row_wise(one, "array<array<binary>>", pa.list_(pa.list_(pa.binary())))(titles.cast("array<binary>"), parents).cast("array<array<string>>")


def places(titles: Column, text: Column) -> Column:
    """Where each title stands in the text, looked for from the place of the one before; if it isn't there, that one's place."""

    def one(titles: list[bytes], text: bytes | None) -> list[int]:
        found, at, missing = [], 0, set()
        text = None if text is None else text.decode("utf-8", "surrogateescape")
        for title in (t.decode("utf-8", "surrogateescape") for t in titles):
            # what isn't there from an earlier place on isn't there from a later one
            spot = -1 if text is None or title in missing else text.find(title, at)
            if spot < 0:
                missing.add(title)
            else:
                at = spot
            found.append(at)
        return found

    return row_wise(one, "array<int>", pa.list_(pa.int32()))(titles.cast("array<binary>"), text.cast("binary"))


def holders(ranges: Column) -> Column:
    """For each number from 0 the greatest key of the ranges (key, first, last) that hold it, or null."""

    def one(ranges: list[list[int]]) -> list[int | None]:
        found: list[int | None] = [None] * (1 + max(ranges[2], default=-1))
        onward = list(range(len(found) + 1))

        def free(k: int) -> int:
            """The first number from k on that has no key yet."""
            end = k
            while onward[end] != end:
                end = onward[end]
            while onward[k] != end:
                onward[k], k = end, onward[k]
            return end

        for key, first, last in sorted(zip(*ranges), reverse=True):
            k = free(first)
            while k <= last:
                found[k], onward[k] = key, k + 1
                k = free(k + 1)
        return found

    return row_wise(one, "array<int>", pa.list_(pa.int32()))(ranges)
