import pytest

from fieldloom.plans.matches import BAN_PATHS, DICTIONARY
from fieldloom.schema import ALL, KNOWN, OUTCOME, UNKNOWN, WIN, Dictionary, Field, expand_ignored, int_storage


@pytest.mark.parametrize(
    "lo, hi, want",
    [(0, 255, "u1"), (0, 256, "u2"), (0, 65536, "u4"), (0, 1 << 32, "u8"), (-1, 127, "i1"), (-1, 128, "i2"),
     (-128, 0, "i2"), (-40000, 10, "i4"), (-(1 << 40), 0, "i8")],
)
def test_int_storage(lo, hi, want):
    assert int_storage(lo, hi) == want


def test_int_storage_too_large():
    with pytest.raises(ValueError):
        int_storage(0, 1 << 64)


def test_widths_of_the_stand_in():
    assert [DICTIONARY.width(m) for m in (KNOWN, OUTCOME, WIN, UNKNOWN, ALL)] == [390, 563, 2, 565, 955]
    assert DICTIONARY.portion_slice(UNKNOWN) == (390, 955)
    assert DICTIONARY.portion_slice(ALL - WIN) == (0, 953)


def test_unknown_portion_and_field():
    with pytest.raises(ValueError):
        DICTIONARY.select(16)
    with pytest.raises(IndexError):
        DICTIONARY["participants.0.none"]


@pytest.mark.parametrize("change", [{"kind": "date"}, {"handling": "none"}, {"occurrence": "per-game"}])
def test_undeclared_words_are_refused(change):
    with pytest.raises(ValueError):
        Field(**{"path": "a", "kind": "int", "handling": "unary", "portion": KNOWN, **change})


def test_family_bounds_cover_every_slot():
    fields = [
        Field(f"participants.{i}.x", "int", "unary", OUTCOME, occurrence="per-participant", min=i, max=10 + i, default=0)
        for i in range(10)
    ]
    assert Dictionary(fields).family_bounds(fields[3]) == (0, 19)


def test_ignored_words():
    assert expand_ignored("none") == frozenset()
    assert expand_ignored("bans:duration", BAN_PATHS) == {*BAN_PATHS, "duration"}
