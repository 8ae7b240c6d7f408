"""Decoding expressions as SQL text over one encoded array."""

from __future__ import annotations

from fieldloom.functions.text import array, literal
from fieldloom.schema import Span


def cut(x: str, start: int, width: int) -> str:
    """Columns [start, start + width) of an encoded array."""
    return f"slice({x}, {start + 1}, {width})"


def argmax(x: str) -> str:
    """0-based position of the first maximum; null if all cells are null."""
    return f"cast(array_position({x}, array_max({x})) - 1 as int)"


def count_above(x: str, threshold: float = 0.0) -> str:
    return f"size(filter({x}, v -> v > {threshold}D))"


def field_value(x: str, span: Span, decode_base: str = "family") -> str:
    """Typed value of one field; null where the encoded part is null.

    ``decode_base`` is the level added to a unary count: the minimum over the
    family, which inverts the encoding, or the field's own (``"field"``).
    """
    f = span.field
    kind = f.spark_type.simpleString()
    first = f"get({x}, {span.start})"
    if f.handling == "one-hot":
        levels = [True, False] if f.kind == "bool" else f.levels
        return f"get({array(levels)}, {argmax(cut(x, span.start, span.width))})"
    if f.handling == "unary":
        base = span.lo if decode_base == "family" else int(f.min)
        if not span.width:
            return f"cast({base} as {kind})"
        count = count_above(cut(x, span.start, span.width))
        return f"try_cast(if({first} IS NOT NULL, {count} + {base}, NULL) as {kind})"
    if f.handling == "bool":
        if f.kind == "bool":
            return f"{first} > 0"
        if f.kind == "enum":
            other = next(level for level in f.levels if level != f.mode)
            high, low = literal(f.mode), literal(other)
        else:
            high, low = literal(float(f.mean + f.sd)), literal(float(f.mean - f.sd))
        value = f"CASE WHEN {first} > 0 THEN {high} WHEN {first} IS NOT NULL THEN {low} END"
        return value if f.kind == "enum" else f"try_cast({value} as {kind})"
    value = f"(cast({first} as double) * {literal(float(f.sd))} + {literal(float(f.mean))})"
    # greatest and least skip nulls, so an ignored cell is kept apart.
    bounded = f"least({value}, {literal(float(f.cap))})"
    lowest = 0.0 if f.min >= 0 else -float(f.cap)
    bounded = f"greatest({bounded}, {literal(lowest)})"
    return f"try_cast(if({first} IS NULL, NULL, {bounded}) as {kind})"
