"""Row-wise work on wide records: fill, encode, project, decode, mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.decode import cut, field_value
from fieldloom.functions.encode import encoded_text, fill_default
from fieldloom.functions.text import name
from fieldloom.schema import ALL, KNOWN, OUTCOME, WIN, Dictionary, Span

# One array column per portion, so that a Parquet scan can prune the others.
PORTION_COLUMNS = {"known": KNOWN, "unknown": OUTCOME, "win": WIN}


def fill_defaults(df: DataFrame, dictionary: Dictionary, mask: int = ALL) -> DataFrame:
    """Typed fields without nulls or undeclared levels; other columns pass."""
    filled = {f.column: f"{fill_default(f)} as {name(f.column)}" for f in dictionary.select(mask)}
    return df.selectExpr(*[filled.get(c, name(c)) for c in df.columns])


def encoded_array(spans: list[Span]) -> Column:
    """One array with the encoded columns of the spans, from raw fields."""
    return F.expr(encoded_text(spans))


def encode_records(
    df: DataFrame, dictionary: Dictionary, portions=("known", "unknown", "win"), keep=("rec_id",)
) -> DataFrame:
    """Raw or filled records as one float array per portion, in layout order."""
    arrays = [
        encoded_array(dictionary.portion_spans(PORTION_COLUMNS[p])).alias(p) for p in portions
    ]
    return df.select(*keep, *arrays)


def project_portion(x: str, dictionary: Dictionary, mask: int) -> Column:
    """A portion cut out of the full encoded row in column ``x``."""
    start, stop = dictionary.portion_slice(mask)
    return F.expr(cut(name(x), start, stop - start))


def assign_portions(dictionary: Dictionary, parts: dict[str, Column], mask: int = ALL) -> Column:
    """A full encoded row from its parts; parts not given stay null."""
    out = []
    for name, bit in PORTION_COLUMNS.items():
        if not mask & bit:
            continue
        blank = F.array_repeat(F.lit(None).cast("double"), dictionary.width(bit))
        out.append(parts[name].cast("array<double>") if name in parts else blank)
    return F.concat(*out)


def drop_short(df: DataFrame, column: str = "duration", above: float = 900) -> DataFrame:
    """Drop abandoned games: keep rows strictly above the threshold.

    Written on the raw column so that the predicate reaches the scan.
    """
    return df.where(F.col(column) > F.lit(above))


def drop_short_encoded(
    df: DataFrame, dictionary: Dictionary, path: str = "duration", above: float = 900,
    column: str = "unknown",
) -> DataFrame:
    """The same filter on an encoded corpus, through the frozen statistics."""
    span = next(s for s in dictionary.portion_spans(OUTCOME) if s.field.path == path)
    # Rounded to the corpus' float width, so that the threshold itself stays out.
    cutoff = F.lit((above - span.field.mean) / span.field.sd).cast("float")
    return df.where(F.get(F.col(column), F.lit(span.start)) > cutoff)


def decode_records(
    df: DataFrame,
    dictionary: Dictionary,
    sources: dict[str, str],
    keep=("rec_id",),
    decode_base: str = "family",
) -> DataFrame:
    """Typed fields in dictionary order; ``sources`` names the array column of
    each portion."""
    by_path = {}
    for portion, column in sources.items():
        for span in dictionary.portion_spans(PORTION_COLUMNS[portion]):
            by_path[span.field.path] = field_value(name(column), span, decode_base)
    columns = [f"{by_path[f.path]} as {name(f.column)}" for f in dictionary if f.path in by_path]
    return df.selectExpr(*[name(k) for k in keep], *columns)


def mask_ignored(x: str, dictionary: Dictionary, ignored, mask: int = OUTCOME, fill=None) -> Column:
    """Ignored fields' encoded columns of array ``x`` become ``fill`` (null or 0)."""
    spans = dictionary.portion_spans(mask)
    blank = "cast(NULL as double)" if fill is None else f"{float(fill)}D"
    pieces, start = [], 0
    for s in spans:
        if s.field.path not in ignored:
            continue
        if s.start > start:
            pieces.append(cut(name(x), start, s.start - start))
        pieces.append(f"array_repeat({blank}, {s.width})")
        start = s.stop
    width = spans[-1].stop
    if start < width:
        pieces.append(cut(name(x), start, width - start))
    return F.expr("concat(" + ", ".join(f"cast({p} as array<double>)" for p in pieces) + ")")
