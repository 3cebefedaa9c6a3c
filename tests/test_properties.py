"""Property tests: column validators vs plain-Python versions of the
reference's JavaScript rules (``^...$`` without the m flag = full match,
``\\d`` = ASCII digits)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewise.functions.hours import clock_seconds, valid_weekly_value
from platewise.functions.text import is_alnum, is_email

ALNUM = re.compile(r"[A-Za-z0-9]+")
EMAIL = re.compile(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}")
RANGE = re.compile(r"[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2}")
CLOCK = re.compile(r"([0-9]{1,2}):([0-9]{2})")

# alphabets that hit both sides of every rule, with the usual troublemakers
chars = st.sampled_from(list("aZ09:-.@_%+ \n\t") + ["٣", "é", "Ａ"])
texts = st.lists(st.text(alphabet=chars, max_size=14), min_size=1, max_size=300)
clockish = st.lists(st.from_regex(r"\A[0-9]{1,3}:[0-9]{1,3}(-[0-9]{2}:[0-9]{2})?\n?\Z"), min_size=1, max_size=200)

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


@SETTINGS
@given(values=texts)
def test_alnum_and_email(spark, values):
    assert evaluate(spark, values, is_alnum) == [ALNUM.fullmatch(v) is not None for v in values]
    assert evaluate(spark, values, is_email) == [EMAIL.fullmatch(v) is not None for v in values]


@SETTINGS
@given(values=st.one_of(texts, clockish))
def test_weekly_value(spark, values):
    exp = [v == "closed" or RANGE.fullmatch(v) is not None for v in values]
    assert evaluate(spark, values, valid_weekly_value) == exp


@SETTINGS
@given(values=clockish)
def test_clock_seconds(spark, values):
    def ref(v):
        m = CLOCK.fullmatch(v)
        if not m:
            return None
        h, mi = int(m.group(1)), int(m.group(2))
        return h * 3600 + mi * 60 if h <= 23 and mi <= 59 else None
    assert evaluate(spark, values, clock_seconds) == [ref(v) for v in values]
