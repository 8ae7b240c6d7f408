"""Dictionary-driven analytics over wide match records, written for Spark.

A data dictionary declares every field (format, levels, encoding, default,
frozen statistics).  The package turns that declaration into DataFrame jobs:
read and fill, encode and decode, split and augment, score, evaluate, fit.
"""

from fieldloom.schema import (  # noqa: F401
    ALL,
    KNOWN,
    OUTCOME,
    UNKNOWN,
    WIN,
    Dictionary,
    Field,
)
