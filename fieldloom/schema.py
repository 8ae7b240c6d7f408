"""The declared schema: fields, portions and the encoded layout they imply.

These objects are small (one entry per declared field or encoded column), live
on the driver and only serve to build Column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import types as T

# Portion bits.
KNOWN = 1
WIN = 2
OUTCOME = 4
EXTRA = 8
UNKNOWN = WIN | OUTCOME
ALL = KNOWN | UNKNOWN | EXTRA

HANDLINGS = ("continuous", "one-hot", "bool", "unary")
OCCURRENCES = ("single", "per-participant", "per-team")

_SLOT = re.compile(r"^(participants|teams)\.\d+\.")


def int_storage(lo: int, hi: int) -> str:
    """Smallest integer storage (``u1`` .. ``i8``) for values in [lo, hi]."""
    signed = lo < 0
    extreme = max(abs(lo), abs(hi))
    for width in (1, 2, 4, 8):
        if extreme < 1 << (8 * width - signed):
            return ("i" if signed else "u") + str(width)
    raise ValueError(f"no integer storage holds [{lo}, {hi}]")


# Spark type and largest value of each integer storage.  Spark
# has no unsigned types, so each one goes to the next wider signed type.
STORAGE_TYPES = {
    "u1": (T.ShortType(), (1 << 8) - 1),
    "u2": (T.IntegerType(), (1 << 16) - 1),
    "u4": (T.LongType(), (1 << 32) - 1),
    "u8": (T.DecimalType(20, 0), (1 << 64) - 1),
    "i1": (T.ByteType(), (1 << 7) - 1),
    "i2": (T.ShortType(), (1 << 15) - 1),
    "i4": (T.IntegerType(), (1 << 31) - 1),
    "i8": (T.LongType(), (1 << 63) - 1),
}
FLOAT_MAX = 3.4028234663852886e38


@dataclass(frozen=True)
class Field:
    """One dictionary row."""

    path: str
    kind: str  # int | float | bool | enum
    handling: str
    portion: int
    occurrence: str = "single"
    levels: tuple[str, ...] = ()
    optional: bool = False
    default: object = None
    mean: float | None = None
    sd: float | None = None
    md: float | None = None
    min: float | None = None
    max: float | None = None
    median: object = None
    mode: object = None

    def __post_init__(self):
        if self.kind not in ("int", "float", "bool", "enum"):
            raise ValueError(f"{self.path}: unknown format {self.kind!r}")
        if self.handling not in HANDLINGS:
            raise ValueError(f"{self.path}: unknown handling {self.handling!r}")
        if self.occurrence not in OCCURRENCES:
            raise ValueError(f"{self.path}: unknown occurrence {self.occurrence!r}")

    @property
    def column(self) -> str:
        return self.path.replace(".", "_")

    @property
    def family(self) -> str:
        return _SLOT.sub(r"\1.*.", self.path)

    @property
    def storage(self) -> str:
        if self.kind == "int":
            return int_storage(int(self.min), int(self.max))
        return {"float": "f4", "bool": "bool", "enum": "category"}[self.kind]

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "int":
            return STORAGE_TYPES[self.storage][0]
        return {"float": T.FloatType(), "bool": T.BooleanType(), "enum": T.StringType()}[self.kind]

    @property
    def cap(self) -> float:
        """Largest value the storage type holds."""
        return STORAGE_TYPES[self.storage][1] if self.kind == "int" else FLOAT_MAX


@dataclass(frozen=True)
class Span:
    """The encoded columns of one field: positions [start, start + width)."""

    field: Field
    start: int
    width: int
    lo: int | None = None  # family minimum of a unary field

    @property
    def stop(self) -> int:
        return self.start + self.width


class Dictionary:
    """Declared fields in dictionary order."""

    def __init__(self, fields, known_order=None):
        self.fields: tuple[Field, ...] = tuple(fields)
        self._by_path = {f.path: f for f in self.fields}
        if len(self._by_path) != len(self.fields):
            raise ValueError("a path is declared twice")
        self.known_order = tuple(known_order or (f.path for f in self.select(KNOWN)))

    def __getitem__(self, path: str) -> Field:
        if path not in self._by_path:
            raise IndexError(f"field {path!r} not found")
        return self._by_path[path]

    def __iter__(self):
        return iter(self.fields)

    def select(self, mask: int) -> list[Field]:
        """Fields of a portion mask, in dictionary order."""
        if not mask & ALL or mask & ~ALL:
            raise ValueError(f"unknown portion {mask}")
        return [f for f in self.fields if f.portion & mask]

    def subset(self, mask: int) -> Dictionary:
        return Dictionary(self.select(mask))

    def family_bounds(self, field: Field) -> tuple:
        """Minimum and maximum over every slot of the field's family."""
        kin = [f for f in self.fields if f.family == field.family]
        return min(f.min for f in kin), max(f.max for f in kin)

    @cached_property
    def spans(self) -> tuple[Span, ...]:
        """Encoded spans: known fields first, then unknown, then win."""
        out, start = [], 0
        for portion in (KNOWN, OUTCOME, WIN):
            for f in self.fields:
                if f.portion != portion:
                    continue
                lo = None
                if f.handling == "one-hot":
                    width = 2 if f.kind == "bool" else len(f.levels)
                elif f.handling == "unary":
                    lo, hi = (int(v) for v in self.family_bounds(f))
                    width = hi - lo
                else:
                    width = 1
                out.append(Span(f, start, width, lo))
                start += width
        return tuple(out)

    def portion_spans(self, mask: int, rebase: bool = True) -> list[Span]:
        """Spans of a portion; positions count from the portion's start."""
        spans = [s for s in self.spans if s.field.portion & mask]
        if not spans:
            raise LookupError(f"portion {mask} has no encoded columns")
        base = spans[0].start if rebase else 0
        return [Span(s.field, s.start - base, s.width, s.lo) for s in spans]

    def portion_slice(self, mask: int) -> tuple[int, int]:
        """First and one-past-last encoded position of a portion."""
        spans = self.portion_spans(mask, rebase=False)
        return spans[0].start, spans[-1].stop

    def width(self, mask: int = ALL) -> int:
        return sum(s.width for s in self.portion_spans(mask))

    def schema(self, paths=None, dotted: bool = False) -> T.StructType:
        """Explicit read schema for the given paths (dictionary order if none)."""
        fields = [self[p] for p in paths] if paths is not None else self.fields
        return T.StructType(
            [T.StructField(f.path if dotted else f.column, f.spark_type, True) for f in fields]
        )


def expand_ignored(spec, ban_paths=()) -> frozenset[str]:
    """Parse a ``:``-joined ignore list; ``bans`` stands for every ban field."""
    if not spec or spec == "none":
        return frozenset()
    words = spec.split(":")
    paths = {w for w in words if w != "bans"}
    if "bans" in words:
        paths.update(ban_paths)
    return frozenset(paths)
