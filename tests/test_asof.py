import random

import pandas as pd
import pytest

from platewise.operators.asof import carry_forward


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_carry_forward_matches_ffill_with_a_hot_key(spark, parts):
    rnd = random.Random(parts)
    rows = []
    for i in range(3000):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 40)      # key 0 holds ~40% of rows
        val = rnd.randint(1, 999) if rnd.random() < 0.2 else None
        rows.append((key, i, val))
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r.k, r.t): r.c for r in carry_forward(df, "k", ["t"], "v", "c", num_partitions=parts).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
    pdf["c"] = pdf.groupby("k")["v"].ffill()
    exp = {(k, t): (None if pd.isna(c) else int(c)) for k, t, c in zip(pdf.k, pdf.t, pdf.c)}
    assert got == exp
