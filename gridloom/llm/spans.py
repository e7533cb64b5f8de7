"""Spans of regular expressions by built-in expressions only.

Spark has no function for the positions of all matches. ``split`` with limit -1 returns the gaps between the matches
and ``regexp_extract_all`` the matches themselves, so a running sum of their lengths (code points) gives every span.

An array that grows by one element at each step of a fold is copied each time. The folds here go over pieces of about the
square root of the length, so that even a text with 100,000 spans takes seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<s:int,e:int,m:string,g:string>>"
PIECE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _pieces(items: Column) -> tuple[Column, Column]:
    """(starts, length) of pieces of an array; no starts for an empty one."""
    n = F.size(items)
    length = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(n)).cast("int"))
    return F.when(n > 0, F.sequence(F.lit(1), n, length)).otherwise(F.array().cast("array<int>")), length


def running(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Struct (state, out): a fold over ``items`` in which ``step(state, x)`` gives the next state and an element of ``out``, an array of
    type ``kind``."""
    empty, nested = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, got = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(got)).cast(kind).alias("out"))

    def folded(xs: Column) -> Column:
        starts, length = _pieces(xs)

        def piece(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(xs, at, length), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(
            starts, F.struct(start.alias("state"), nested.alias("out")), piece, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out"))
        )

    return let(items, folded)


def regex_hits(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (s, e, m, g): start, end (exclusive), match, and the given group, leftmost and not overlapping."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(gaps.alias("gap"), found.alias("m"), parts.alias("g"))
    both = F.filter(both, lambda x: x["m"].isNotNull())  # the last gap has no match after it

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        return end, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["g"].alias("g"))

    return running(both, F.lit(0), HIT, step)["out"]


def in_context(hits: Column, text: Column, before: int, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(hit, before, after)`` for each hit, with up to so many characters before it and one behind it. Each piece of hits cuts
    its stretch of the text once, as finding a character's place means counting from the start."""

    def pieces(xs: Column) -> Column:
        starts, length = _pieces(xs)

        def piece(part: Column) -> Column:
            at = F.greatest(F.get(part, F.lit(0))["s"] - before, F.lit(0))
            line = F.struct(F.substring(text, at + 1, F.element_at(part, -1)["e"] + 1 - at).alias("t"), at.alias("at"))

            def one(x: Column, line: Column) -> Column:
                start = F.greatest(x["s"] - before, F.lit(0))
                left = F.substring(line["t"], start - line["at"] + 1, x["s"] - start)
                right = F.substring(line["t"], x["e"] - line["at"] + 1, F.lit(1))
                return let(F.struct(left.alias("b"), right.alias("a")), lambda c: use(x, c["b"], c["a"]))

            return let(line, lambda ln: F.transform(part, lambda x: one(x, ln)))

        return F.flatten(F.transform(starts, lambda at: let(F.slice(xs, at, length), piece)))

    return let(hits, pieces)


def not_beaten(spans: Column, others: Column, beats: Callable[[Column, Column], Column]) -> Column:
    """``spans`` without those that an overlapping one of ``others`` beats: ``beats(other, span)``. Both have s and e; spans in order
    of s are compared piece by piece with those of the others that reach into the piece."""

    def pieces(xs: Column, ys: Column) -> Column:
        starts, length = _pieces(xs)

        def piece(part: Column) -> Column:
            low, high = F.array_min(F.transform(part, lambda a: a["s"])), F.array_max(F.transform(part, lambda a: a["e"]))
            near = let(F.struct(low.alias("s"), high.alias("e")), lambda box: F.filter(ys, lambda b: (b["s"] < box["e"]) & (b["e"] > box["s"])))
            return let(near, lambda bs: F.filter(part, lambda a: ~F.exists(bs, lambda b: (a["s"] < b["e"]) & (b["s"] < a["e"]) & beats(b, a))))

        return F.flatten(F.transform(starts, lambda at: let(F.slice(xs, at, length), piece)))

    return let(spans, lambda xs: let(others, lambda ys: pieces(xs, ys)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every span of a sorted array (s, e) replaced by ``mark``; one that starts within another is swallowed."""
    kind = "array<struct<s:int,e:int>>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        keep = F.struct(at.alias("s"), F.when(x["s"] >= at, x["s"]).alias("e"))
        return F.greatest(at, x["e"]), keep

    def rest(r: Column) -> Column:
        return F.substring(text, r["state"] + 1, F.char_length(text))

    def parts(gaps: Column) -> Column:
        starts, length = _pieces(gaps)

        def piece(part: Column) -> Column:
            first, last = F.get(part, F.lit(0))["s"], F.element_at(part, -1)["e"]
            line = F.struct(F.substring(text, first + 1, last - first).alias("t"), first.alias("at"))
            return let(line, lambda x: F.array_join(F.transform(part, lambda gap: F.concat(F.substring(x["t"], gap["s"] - x["at"] + 1, gap["e"] - gap["s"]), F.lit(mark))), ""))

        return F.array_join(F.transform(starts, lambda at: let(F.slice(gaps, at, length), piece)), "")

    folded = running(spans, F.lit(0), kind, step)
    return let(folded, lambda r: F.concat(let(F.filter(r["out"], lambda x: x["e"].isNotNull()), parts), rest(r)))


def labelled(hits: Column, rank: int, kind: str) -> Column:
    """Array of (s, k, kind, e), which sorts by start and then by the listing order of kinds."""
    return F.transform(
        hits, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )
