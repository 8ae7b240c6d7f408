"""Formula networks of the queries and the scored records they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.records import encode_records
from fieldloom.operators.scoring import head_kinds, score_chain
from fieldloom.plans.matches import DICTIONARY, records
from fieldloom.schema import KNOWN, OUTCOME

HIDDEN = 8


def formula_network(sizes, scale: float):
    """w[i][j] = ((31i + 17j) mod 13 - 6) / scale and
    b[j] = ((7j) mod 5 - 2) / scale; the last layer adds (j mod 7 + 1) * 1e-6,
    which keeps logits off exact zeros and ties."""
    network = []
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        i, j = np.arange(n_in)[:, None], np.arange(n_out)
        network.append((((i * 31 + j * 17) % 13 - 6) / scale, ((j * 7) % 5 - 2) / scale))
    w, b = network[-1]
    network[-1] = (w, b + (np.arange(len(b)) % 7 + 1) * 0.000001)
    return network


N_KNOWN, N_UNKNOWN = DICTIONARY.width(KNOWN), DICTIONARY.width(OUTCOME)
GENERATOR = formula_network([N_KNOWN, HIDDEN, N_UNKNOWN], 10.0)
WIN_NETWORK = formula_network([N_KNOWN + N_UNKNOWN, HIDDEN, 1], 100.0)
KINDS = head_kinds(DICTIONARY)


def encoded(spark: SparkSession, sf_dir: str, portions=("known", "unknown", "win")) -> DataFrame:
    return encode_records(records(spark, sf_dir), DICTIONARY, portions)


def scored(spark: SparkSession, sf_dir: str, columns=("y", "z"), when: str | None = None) -> DataFrame:
    """rec_id and, of known, y (truth), z (generator logits), win and win_logit, the ``columns`` named.

    Records are encoded and scored as they are read: arrays of so many cells are some forty
    times the records, so they are not stored. ``when`` keeps the records it holds for.
    """
    rows = records(spark, sf_dir) if when is None else records(spark, sf_dir).where(when)
    portions = ["known", *["unknown"] * ("y" in columns), *["win"] * ("win" in columns)]
    rows = encode_records(rows, DICTIONARY, portions)
    outputs = [o for o, c in (("unknown_logit", "z"), ("win_logit", "win_logit")) if c in columns]
    drop = () if "known" in columns else ("known",)
    rows = score_chain(rows, GENERATOR, WIN_NETWORK, KINDS, outputs=outputs, drop=drop)
    return rows.withColumnsRenamed({"unknown": "y", "unknown_logit": "z"}).select("rec_id", *columns)


def checksum(array: str, name: str, digits: int = 4):
    """Plain and position-weighted sum of an array column."""
    plain = F.expr(f"aggregate({array}, 0D, (a, v) -> a + v)")
    weighted = F.expr(f"aggregate(transform({array}, (v, i) -> v * cast(i % 97 as double)), 0D, (a, v) -> a + v)")
    return [F.round(plain, digits).alias(f"{name}_sum"), F.round(weighted, digits).alias(f"{name}_dot")]
