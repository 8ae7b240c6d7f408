"""SQL expression text.  Wide records need expressions over thousands of
columns; one parsed text per record part is far cheaper to build than as many
Column objects."""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"({value!r}D)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"
