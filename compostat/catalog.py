"""All registered queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_chain, queries_data, queries_eav, queries_graph, queries_more, queries_stats  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401


def entry(spark: SparkSession) -> DataFrame:
    """Meta-analysis of CLR contrasts on the smallest tables, whose few samples an arm ask
    for low floors."""
    from .operators import compose, differential
    from .plans import views

    folder = "/root/testdata/sf0.001"
    values, zeros, _ = compose.clr(views.counts(spark, folder))
    moments = differential.contrast_moments(values, zeros, views.frame(spark, folder), 0.1)
    contrasts = differential.ols_contrasts(moments.filter("n_case >= 2 AND n_control >= 2"))
    return differential.meta_analysis(contrasts, with_p=False)
