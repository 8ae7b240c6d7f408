"""Training and evaluation rows: split, batch, permute, filter, blank, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.records import drop_short, encode_records
from fieldloom.operators.sampling import batch_rows, blank_optional, permute_slots
from fieldloom.schema import Dictionary

# Shares of blanked fields and of untouched rows.
TRAIN_BLANK, TRAIN_KEEP = 0.5, 0.5
EVALUATION_BLANK, EVALUATION_KEEP = 0.1, 0.0


def train_rows(
    split: DataFrame, batch_size: int = 2048, duration: str | None = "duration", above: float = 900
) -> DataFrame:
    """Raw training rows with their batch.

    ``duration=None`` keeps abandoned games, as the win network does.
    """
    rows = batch_rows(split.where(F.col("split") == "train"), batch_size)
    return drop_short(rows, duration, above) if duration else rows


def augmented(rows: DataFrame, dictionary: Dictionary, seed=0, epoch: int = 0, key: str = "rec_id", keep=()) -> DataFrame:
    """Training rows permuted, blanked and encoded, other in every epoch; of ``keep`` the columns they have."""
    drawn = f"{seed}/{epoch}"
    rows = permute_slots(rows, dictionary, drawn)
    rows = blank_optional(rows, dictionary, TRAIN_BLANK, TRAIN_KEEP, drawn, key)
    return encode_records(rows, dictionary, keep=(key, *[c for c in keep if c in rows.columns]))


def evaluation_rows(
    split: DataFrame, dictionary: Dictionary, seed=0, duration: str | None = "duration", above: float = 900, key: str = "rec_id"
) -> DataFrame:
    """Encoded evaluation rows with a few blanked fields."""
    rows = split.where(F.col("split") == "evaluation")
    if duration:
        rows = drop_short(rows, duration, above)
    rows = blank_optional(rows, dictionary, EVALUATION_BLANK, EVALUATION_KEEP, seed, key)
    return encode_records(rows, dictionary, keep=(key,))
