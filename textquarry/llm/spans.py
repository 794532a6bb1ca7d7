"""Places of regular-expression matches, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(value: Column) -> Column:
    """The characters of a short string."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def scanned(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what `step(carry, item)`, a pair of the next carry and a value to emit, emits for all items in turn.

    Arrays that grow one by one cost the square of their length. Items are
    taken in runs of the root of their number, so n items cost n ** 1.5 copies
    of one reference, and a text of a million matches stays a matter of seconds.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def run(xs: Column, width: Column) -> Column:
        def one(state: Column, x: Column) -> Column:
            after, out = step(state["at"], x)
            return F.struct(after.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

        def part(state: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(xs, k * width + 1, width), F.struct(state["at"].alias("at"), none.alias("out")), one)
            return once(inner, lambda t: F.struct(t["at"].alias("at"), F.concat(state["out"], F.array(t["out"])).alias("out")))

        parts = F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1)
        return F.aggregate(parts, F.struct(start.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), part, lambda s: F.flatten(s["out"]))

    return once(items, lambda xs: F.when(F.size(xs) > 0, once(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda w: run(xs, w))).otherwise(none))


def match_spans(text: Column, pattern: str, keep_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Matches whose group `keep_group` is shorter than `least` are consumed but
    left out. The pattern must not match the empty string: the pieces that a
    split leaves and the matches then alternate, and their lengths give the places.
    """
    kind = "struct<start:int,end:int,value:string,part:string>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)) if keep_group else None
    gaps = F.split(text, pattern, -1)

    def step(at: Column, z: Column) -> tuple[Column, Column]:
        start = at + F.length(z["gap"])
        end = start + F.length(z["value"])
        return end, F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value"), (z["part"] if keep_group else z["value"]).alias("part"))

    def zipped(values: Column) -> Column:
        return F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value"), *([group.alias("part")] if keep_group else []))

    placed = scanned(once(whole, zipped), F.lit(0), step, kind)
    kept = F.filter(placed, lambda s: F.length(s["part"]) >= least) if least else placed
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
