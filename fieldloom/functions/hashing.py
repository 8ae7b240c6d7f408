"""Reproducible draws: a uniform number from a seed and row keys."""

from __future__ import annotations

import math

from fieldloom.functions.text import literal


def digest_text(seed, *parts) -> str:
    """Hex md5 of ``seed:part:part...``; an order key for seeded shuffles.

    Parts are SQL expressions or plain numbers.
    """
    return f"md5(concat_ws(':', {', '.join([literal(str(seed)), *[f'cast({p} as string)' for p in parts]])}))"


def draw_text(seed, *parts) -> str:
    """Uniform double in [0, 1) that depends only on the seed and the keys."""
    head = f"conv(substring({digest_text(seed, *parts)}, 1, 8), 16, 10)"
    return f"(cast({head} as bigint) / 4294967296D)"


HEX = 8  # hex digits per draw; one digest holds four


def below_text(digest: str, nth: int, share: float) -> str:
    """Whether the ``nth`` draw of a digest is below ``share``.  Hex digits sort
    like the number they stand for, so no conversion is needed."""
    bound = min(max(math.ceil(share * 16**HEX), 0), 16**HEX)
    if bound == 16**HEX:
        return "true"
    return f"substring({digest}, {HEX * nth + 1}, {HEX}) < '{bound:0{HEX}x}'"
