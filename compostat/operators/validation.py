"""Validation: one job per question.  Shuffles, depth thresholds and prevalence tiers
are extra grouping columns, not loops over jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import differential as D
from .sampling import permute_within


def run_chain(values: DataFrame, zeros: DataFrame, frame: DataFrame, cells: DataFrame | None = None, alpha: float = 0.05, scenario: Sequence[str] = (), eb: bool = True, covariates: Sequence[str] = (), pooled_prevalence: float = 0.10, **kw) -> dict[str, DataFrame]:
    """Per-project contrasts, meta-analysis, pooled test on adjusted values, concordance.
    With ``scenario`` columns (see ``contrast_moments``; ``cells`` has them too) the chain
    runs for every scenario at once.  The pooled test comes from sums, of taxa present in
    ``pooled_prevalence`` of a category's samples, or from dense ``cells`` where given (which
    know no covariates)."""
    per = D.within_project(values, zeros, frame, scenario=scenario, covariates=covariates, **kw)
    meta = D.meta_analysis(per, scenario=scenario)
    by = [*scenario, "disease_category"]
    if cells is None:
        from .batch import combat_contrasts, pooled_rows

        rows = pooled_rows(frame, zeros, covariates, scenario)
        pooled = D.bh_fdr(combat_contrasts(values, rows, covariates, scenario, pooled_prevalence, eb), by=by)
    else:
        pooled = D.pooled_ols(D.combat(cells, by, eb), by=by)
    return {"per_project": per, "meta": meta, "pooled": pooled, "concordance": D.concordance(meta, pooled, alpha, scenario)}


def replicated_sets(concordance: DataFrame) -> DataFrame:
    """Per category the sorted taxa replicated in both arms."""
    return concordance.filter("concordance_class = 'replicated'").groupBy("disease_category").agg(F.array_join(F.array_sort(F.collect_set("taxon")), ",").alias("taxa"), F.count_distinct("taxon").alias("n_taxa"))


def shuffled_frames(frame: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` copies of the frame, labels permuted within (category, project); column
    ``shuffle_id`` from 1."""
    ids = frame.select(*frame.columns, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("shuffle_id"))
    return permute_within(ids, ["shuffle_id", "disease_category", "project"], "sample", "y", seed, "shuffle_id")


def shuffle_null(values: DataFrame, zeros: DataFrame, frame: DataFrame, n: int = 10, z: float = 1.96, seed: int = 42, min_prevalence: float = 0.10) -> DataFrame:
    """Meta-analysis hits (|z| over ``z``) per shuffle and category, in one job.

    A sample's labels of all shuffles are one array, so cells are joined and shuffled
    once, whatever ``n``: each shuffle is a pair of sums in the same aggregate.  Arm sizes,
    presence and the sums of both arms together are the same in every shuffle."""
    block, steps = ["disease_category", "project"], range(n)
    labels = shuffled_frames(frame, n, seed).groupBy("sample", *block).agg(F.array_sort(F.collect_list(F.struct("shuffle_id", "y"))).getField("y").alias("ys"))
    rows = labels.join(zeros.toDF("sample", "zero"), "sample")
    zz = F.col("zero") * F.col("zero")

    def sums(x, xx):
        """Sums of a value and its square in each shuffle's case arm, and over both arms."""
        case = [F.col("ys")[k] == 1 for k in steps]
        arrays = [F.array(*(F.sum(F.when(c, v).otherwise(0.0)) for c in case)) for v in (x, xx)]
        return [*(a.alias(f"{name}1") for a, name in zip(arrays, ("s", "q"), strict=True)), F.sum(x).alias("s"), F.sum(xx).alias("q")]

    arms = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("ys", 1)).alias("n_case"), *sums(F.col("zero"), zz)).filter("n_case > 0 AND n_case < n")
    cells = rows.join(values.toDF("sample", "taxon", "v"), "sample").groupBy(*block, "taxon").agg(F.count(F.lit(1)).alias("n_present"), *sums(F.col("v") - F.col("zero"), F.col("v") * F.col("v") - zz))
    met = cells.alias("c").join(arms.alias("a"), block).filter(F.col("n_present") >= F.lit(min_prevalence) * F.col("n"))
    both = lambda c: F.col(f"c.{c}") + F.col(f"a.{c}")
    add = lambda c: F.zip_with(F.col(f"c.{c}"), F.col(f"a.{c}"), lambda x, y: x + y)
    each = met.select(*block, "taxon", "n_case", (F.col("n") - F.col("n_case")).alias("n_control"), both("s").alias("s"), both("q").alias("q"), F.posexplode(F.arrays_zip(add("s1").alias("s1"), add("q1").alias("q1"))).alias("k", "e"))
    each = each.select("*", "e.s1", "e.q1").withColumns({"s0": F.col("s") - F.col("s1"), "q0": F.col("q") - F.col("q1"), "shuffle_id": F.col("k") + 1})
    ssd = lambda a, m: F.greatest(F.lit(0.0), F.col(f"q{a}") - F.col(f"s{a}") * F.col(f"s{a}") / F.col(m))
    moments = each.select("shuffle_id", *block, "taxon", "n_case", "n_control", (F.col("s1") / F.col("n_case")).alias("m1"), (F.col("s0") / F.col("n_control")).alias("m0"), ssd(1, "n_case").alias("ssd1"), ssd(0, "n_control").alias("ssd0"))
    meta = D.meta_analysis(D.ols_contrasts(moments), scenario=["shuffle_id"], with_p=False)
    return meta.groupBy("shuffle_id", "disease_category").agg(F.count(F.lit(1)).alias("n_taxa"), F.count_if(F.abs("z") > z).alias("n_hits"))


def null_summary(null: DataFrame) -> DataFrame:
    per = null.groupBy("shuffle_id").agg(F.sum("n_hits").alias("hits"))
    return per.agg(F.count(F.lit(1)).alias("n_shuffles"), F.sum("hits").alias("total_hits"), F.avg("hits").alias("mean_hits"), F.max("hits").alias("max_hits"))


def at_thresholds(frame: DataFrame, depths: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """The frame once per depth threshold, with the samples that reach it."""
    met = frame.join(depths.select("sample", "depth"), "sample")
    return met.select(*frame.columns, F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("depth"))).alias("threshold"))


def stability(sets: DataFrame, scenario: str, n: int) -> DataFrame:
    """Per (category, taxon) the scenarios it is in, and whether that is all ``n``."""
    return sets.groupBy("disease_category", "taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_set(scenario)), lambda t: t.cast("string")), ",").alias("thresholds"), (F.count_distinct(scenario) == n).alias("stable"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per category: taxa hit in either of two runs and in both."""
    met = a.select("disease_category", "taxon", F.lit(1).alias("in_a")).join(b.select("disease_category", "taxon", F.lit(1).alias("in_b")), ["disease_category", "taxon"], "full_outer")
    return met.groupBy("disease_category").agg(F.count("in_a").alias("hits_a"), F.count("in_b").alias("hits_b"), F.count_if(F.expr("in_a = 1 AND in_b = 1")).alias("hits_shared"))


def transform_sensitivity(values: DataFrame, zeros: DataFrame, frame: DataFrame, a: str, b: str, alpha: float = 0.05, **kw) -> DataFrame:
    """Meta-analysis on two transforms (column ``transform`` of values and zeros): per
    category the taxa tested, hits of each and of both, and the rank correlation of the
    effects of taxa tested in both."""
    from .diversity import average_rank

    meta = D.meta_analysis(D.within_project(values, zeros, frame, scenario=["transform"], **kw), scenario=["transform"])
    key, pick = ["disease_category", "taxon"], lambda t, c: F.max(F.when(F.col("transform") == t, F.col(c)))
    met = meta.groupBy(*key).agg(*(pick(t, c).alias(f"{c}_{n}") for n, t in (("a", a), ("b", b)) for c in ("q", "pooled_effect")))
    hit = [F.coalesce(F.col(f"q_{n}") < alpha, F.lit(False)) for n in "ab"]
    counts = met.groupBy("disease_category").agg(F.count(F.lit(1)).alias("n_taxa"), F.count_if(hit[0]).alias("hits_a"), F.count_if(hit[1]).alias("hits_b"), F.count_if(hit[0] & hit[1]).alias("hits_shared"))
    ranked = met.filter("pooled_effect_a IS NOT NULL AND pooled_effect_b IS NOT NULL").select("disease_category", *(average_rank(f"pooled_effect_{n}", ["disease_category"]).alias(f"r{n}") for n in "ab"))
    return counts.join(ranked.groupBy("disease_category").agg(F.corr("ra", "rb").alias("effect_rho")), "disease_category", "left")


def in_tiers(prevalence: DataFrame, tiers: Sequence[float]) -> DataFrame:
    """(tier, taxon) for every tier whose threshold the taxon reaches."""
    return prevalence.select("taxon", F.explode(F.filter(F.array(*(F.lit(float(t)) for t in tiers)), lambda t: t <= F.col("prevalence"))).alias("tier"))


def literature_check(concordance: DataFrame, priors: DataFrame, top: int = 15, label: str = "genus") -> DataFrame:
    """The replicated taxa, the ``top`` per category by the meta-analysis's q (ties by taxon),
    against expected directions.  ``priors (disease_category, name, direction, priority)``: the
    first prior whose name occurs in the label, either case, counts."""
    w = Window.partitionBy("disease_category").orderBy("meta_q", "taxon")
    best = concordance.filter("concordance_class = 'replicated'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    p = priors.select(F.col("disease_category").alias("__c"), F.lower("name").alias("__n"), "direction", "priority")
    met = best.join(p, (F.col("disease_category") == F.col("__c")) & F.lower(label).contains(F.col("__n")), "left")
    one = met.groupBy("disease_category", "taxon", label, "meta_effect", "meta_q", "place").agg(F.min_by("direction", "priority").alias("expected"))
    observed = F.when(F.col("meta_effect") > 0, "up").otherwise("down")
    verdict = F.when(F.col("expected").isNull(), "no_prior").when(F.col("expected") == F.col("observed"), "concordant").otherwise("discordant")
    return one.withColumn("observed", observed).withColumn("verdict", verdict)


def literature_rollup(checked: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    out = checked.groupBy("disease_category").agg(F.count(F.lit(1)).alias("n_checked"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("concordant", "discordant", "no_prior")))
    if sources is not None:
        out = out.join(sources.groupBy("disease_category").agg(F.array_join(F.array_sort(F.collect_set("doi")), "; ").alias("source_dois")), "disease_category", "left")
    return out


def noise_reading(gaps: DataFrame) -> DataFrame:
    """Whether a mean gap is within two deviations of none."""
    return gaps.withColumn("reading", F.when(F.abs("gap_mean") <= 2 * F.col("gap_sd"), "within noise").otherwise(F.when(F.col("gap_mean") > 0, "gain").otherwise("loss")))


# Reconciliation checks: each returns rows only where something is wrong.


def sums_off(df: DataFrame, group: str, value: str, expected: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    return df.groupBy(group).agg(F.sum(value).alias("total")).filter(F.abs(F.col("total") - expected) > tolerance)


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
