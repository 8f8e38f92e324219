import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import odds as O


def values(spark, column, *rows, schema="p double, o double, u double"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_implied_probability_and_invalid_odds(spark):
    got = values(spark, O.implied_probability(F.col("o")), (0.5, 100.0, None), (0.5, -100.0, None), (0.5, 150.0, None), (0.5, -250.0, None), (0.5, 0.0, None), (0.5, 50.0, None), (0.5, None, None))
    assert got[:4] == pytest.approx([0.5, 0.5, 0.4, 250 / 350])
    assert got[4:] == [None, None, None]


def test_no_vig_needs_both_sides(spark):
    got = values(spark, O.no_vig(F.col("o"), F.col("u")), (0.5, -110.0, -110.0), (0.5, -150.0, 130.0), (0.5, -110.0, None))
    a, b = 150 / 250, 100 / 230
    assert got[:2] == pytest.approx([0.5, a / (a + b)]) and got[2] is None


def test_expected_value_and_kelly(spark):
    ev = values(spark, O.expected_value(F.col("p"), F.col("o")), (0.6, 100.0, None), (0.3, -200.0, None), (None, 100.0, None))
    assert ev[:2] == pytest.approx([0.2, 0.3 * 0.5 - 0.7]) and ev[2] is None
    assert values(spark, O.kelly(F.col("p"), F.col("o")), (0.6, 100.0, None), (0.3, -200.0, None)) == pytest.approx([0.2, 0.0])


def test_fair_odds_round_half_to_even(spark):
    assert values(spark, O.fair_odds(F.col("p")), (0.75, None, None), (0.25, None, None)) == pytest.approx([-300, 300])
    assert values(spark, O.fair_odds_integer(F.col("p")), (100 / 112.5, None, None), (0.5, None, None)) == [-800, -100]


def test_cleaning_and_lines(spark):
    assert values(spark, O.clean(F.col("p")), (math.nan, None, None), (math.inf, None, None), (-math.inf, None, None), (1.5, None, None)) == [None, None, None, 1.5]
    assert values(spark, O.is_half_point(F.col("p")), (4.5, None, None), (4.0, None, None), (-2.5, None, None), (4.500004, None, None)) == [True, False, True, True]
    assert values(spark, O.clip_probability(F.col("p")), (0.0, None, None), (1.0, None, None), (None, None, None)) == [1e-6, 1 - 1e-6, None]
