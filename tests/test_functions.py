from __future__ import annotations

import random

import pytest

from paceline.functions import args
from paceline.functions.numeric import round_exact, share


def test_rounding_is_that_of_exact_decimals(spark):
    rng = random.Random(5)
    values = [1 / 32, 5 / 32, 0.12345, 0.00025, -0.00055, -0.00001, 0.0, 2.5, 1e-12, 123456.78905]
    values += [a / b for b in (3, 7, 32, 160, 2000, 20000) for a in range(0, b, 7)]
    values += [rng.uniform(-2, 2) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3, 4):
        for row in frame.select("x", round_exact("x", digits).alias("y")).collect():
            assert row.y == round(row.x, digits) + 0.0, row
    assert frame.limit(1).select(round_exact("nullif(x, x)").alias("y")).first().y is None


def test_share_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(1, 3), (0, 0), (2, 0)], "a int, b int")
    assert [r[0] for r in frame.select(share("a", "b")).collect()] == [0.3333, 0.0, 0.0]


def test_argument_forms():
    assert args.as_int("12.0", 1) == 12 and args.as_int("", 7) == 7 and args.as_int(None, 7) == 7
    assert args.as_float("0.5", 1.0) == 0.5
    assert args.as_flag("true") and args.as_flag(1) and not args.as_flag("false") and not args.as_flag(None)
    assert args.funnel_steps("a, b ,c") == ["a", "b", "c"]
    for bad in (["a"], list("abcdefg"), None):
        with pytest.raises(ValueError):
            args.funnel_steps(bad)
    with pytest.raises(ValueError):
        args.path_ends("a", "a")
    with pytest.raises(ValueError):
        args.path_ends("a", " ")
    with pytest.raises(ValueError):
        args.profile_condition({"shoe": 3}, ["plan"])
