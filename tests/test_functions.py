import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from compostat.functions import stats as S
from compostat.functions import text as X
from compostat.functions.lineage import genus_label, parse_lineage


def test_normal_and_student_tails():
    assert S.normal_two_sided(np.array([1.959963985, 0.0]))[0] == pytest.approx(0.05, abs=1e-9)
    # Published quantiles of Student's t.
    for t, df, p in ((12.7062047, 1, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01), (1.983971519, 100, 0.05), (0.0, 5, 1.0)):
        assert S.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, abs=1e-8)
    assert S.t_two_sided(np.array([1e3]), np.array([1e5]))[0] < 1e-100
    assert math.isnan(S.t_two_sided(np.array([np.nan]), np.array([3.0]))[0])


def test_incomplete_beta_and_f():
    assert S.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-12)
    assert S.incomplete_beta(2, 3, 0.0) == 0 and S.incomplete_beta(2, 3, 1.0) == pytest.approx(1)
    assert S.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)


def test_exact_rank_test():
    # 3 against 3 without overlap: 2 of 20 arrangements.
    assert S.mann_whitney_exact(9, 3, 3) == pytest.approx(0.1)
    assert S.mann_whitney_exact(4.5, 3, 3) == pytest.approx(1.0)
    assert S.mann_whitney_exact(0, 4, 5) == pytest.approx(2 / 126)


def test_p_columns(spark):
    df = spark.createDataFrame([(1.959963985, 2.228138852, 10.0, 9.0, 3.0, 3.0, 0.0), (None, None, None, None, None, None, None)], "z double, t double, df double, u double, a double, b double, ties double")
    a, b = df.select(S.normal_p("z").alias("p"), S.t_p("t", "df").alias("q"), S.rank_test_p("u", "a", "b", "ties").alias("r")).collect()
    assert (a["p"], a["q"], a["r"]) == (pytest.approx(0.05, abs=1e-8), pytest.approx(0.05, abs=1e-8), pytest.approx(0.1))
    assert tuple(b) == (None, None, None)


def test_null_rules(spark):
    df = spark.createDataFrame([("NA ", "x"), ("\tna", "x"), ("none", "a"), ("None", "x"), ("no", "x"), ("ok ", "x"), (None, "x"), ("", "x"), ("none", None)], "v string, f string")
    out = [r[0] for r in df.select(X.apply_null_rules(F.col("v"), F.col("f"), ["na", ""], {"none": ["a"], "no": []})).collect()]
    assert out == [None, None, "none", None, None, "ok ", None, None, None]


def test_rules_in_order(spark):
    rules = [(["crohn", " cd "], "A"), (["cd"], "B")]
    df = spark.createDataFrame([("Crohn's",), ("has cd now",), ("cd",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(X.first_rule(F.col("v"), rules, "other")).collect()] == ["A", "A", "B", "other", "other"]
    assert [r[0] for r in df.select(X.first_rule(F.col("v"), rules, None)).collect()] == ["A", "A", "B", None, None]


def test_short_lineage_raises(spark):
    df = spark.createDataFrame([("a.b.c.d.e",)], "v string")
    with pytest.raises(Exception, match="lineage needs 6"):
        df.select(parse_lineage(F.col("v"))).collect()
    df = spark.createDataFrame([("NA.NA.NA.NA.NA.NA",)], "v string")
    assert df.select(genus_label(parse_lineage(F.col("v")), F.col("v"))).first()[0] == "NA.NA.NA.NA.NA.NA"
