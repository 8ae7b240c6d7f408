"""Encoding expressions as SQL text: one array per field and a single flat
``concat`` per record part, without lambdas."""

from __future__ import annotations

from fieldloom.functions.text import array, literal, name
from fieldloom.schema import Field, Span


def fill_default(field: Field, value: str | None = None) -> str:
    """Null, or a value outside an enum's levels, becomes the typed default."""
    value = value or name(field.column)
    default = literal(field.default)
    if field.kind == "enum":
        return f"if(array_contains({array(field.levels)}, {value}), {value}, {default})"
    return f"cast(coalesce({value}, {default}) as {field.spark_type.simpleString()})"


def onehot(value: str, levels, default=None) -> str:
    """1 at the level's position, 0 elsewhere; all 0 for any other value, or 1 at
    the default's position if one is given.

    The row is a window over n zeros, a one and n zeros, which the optimizer folds
    into one constant.
    """
    n = len(levels)
    index = f"array_position({array(levels)}, {value})"
    if default in levels:
        index = f"coalesce(nullif({index}, 0), {list(levels).index(default) + 1})"
    else:
        index = f"coalesce({index}, 0)"
    base = f"concat(array_repeat(0F, {n}), array(1F), array_repeat(0F, {n}))"
    return f"slice({base}, cast({n + 2} - {index} as int), {n})"


def thermometer(value: str, lo: int, width: int) -> str:
    """``value >= k`` for every k in (lo, lo + width]: a window over ones, zeros."""
    lit = f"greatest(0, least(floor(cast({value} as double)) - {lo}, {width}))"
    base = f"concat(array_repeat(1F, {width}), array_repeat(0F, {width}))"
    return f"slice({base}, cast({width + 1} - {lit} as int), {width})"


def flag(condition: str) -> str:
    return f"array(if({condition}, 1F, 0F))"


def zscore(value: str, mean: float, sd: float) -> str:
    """``(value - mean) / sd``; 0 for a constant field, whose sd is 0."""
    if not sd:
        return "array(0F)"
    mean, sd = literal(float(mean)), literal(float(sd))
    return f"array(cast((cast({value} as double) - {mean}) / {sd} as float))"


def field_array(span: Span) -> str:
    """Encoded columns of one field from its raw value; defaults are filled in."""
    f = span.field
    if f.handling == "one-hot" and f.kind == "enum":
        return onehot(name(f.column), f.levels, f.default)
    value = fill_default(f)
    if f.handling == "one-hot":
        return f"concat({flag(value)}, {flag(f'NOT {value}')})"
    if f.handling == "unary":
        return thermometer(value, span.lo, span.width)
    if f.handling == "bool":
        if f.kind == "enum":
            return flag(f"{value} = {literal(f.mode)}")
        number = f"cast({value} as int)" if f.kind == "bool" else value
        return flag(f"cast({number} as double) > {literal(float(f.mean))}")
    return zscore(value, f.mean, f.sd)


def encoded_text(spans) -> str:
    """One array with the encoded columns of all spans."""
    return "concat(" + ", ".join(field_array(s) for s in spans) + ")"
