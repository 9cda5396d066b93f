"""Graphs as DataFrames: taxonomy forests, bipartite and nearest-neighbour edges,
subgraphs, neighbour sampling and message propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import prefixes
from ..functions.stats import hash_order
from .compose import edge_weight


def taxonomy_nodes(leaves: DataFrame) -> DataFrame:
    """Forest of ``leaves (pos, parts array<string>)``: leaves first by position, then inner
    nodes (all proper prefixes) by rank and lineage; ``parent`` is a node id, -1 at a
    root.  Leaves with the same lineage raise.  A taxonomy is small (thousands of
    nodes), so its numbering is one ordered window."""
    twice = Window.partitionBy("parts")
    leaf = leaves.select("pos", "parts", F.lit(True).alias("is_leaf"), F.when(F.count(F.lit(1)).over(twice) > 1, F.raise_error(F.concat(F.lit("repeated lineage "), F.array_join("parts", ".")))).otherwise(F.size("parts")).cast("int").alias("rank"))
    inner = leaves.select(F.explode(prefixes(F.col("parts"))).alias("parts")).distinct().select(F.lit(None).cast("int").alias("pos"), "parts", F.lit(False).alias("is_leaf"), F.size("parts").alias("rank"))
    order = Window.orderBy(~F.col("is_leaf"), F.col("pos"), F.col("rank"), F.array_join("parts", "\u0001"))
    nodes = leaf.unionByName(inner).withColumn("node_id", (F.row_number().over(order) - 1).cast("int"))
    up = nodes.filter("NOT is_leaf").select(F.col("parts").alias("__up"), F.col("node_id").alias("__parent"))
    return nodes.join(up, F.slice(nodes["parts"], 1, F.size(nodes["parts"]) - 1) == up["__up"], "left").select("node_id", "parts", "rank", F.element_at("parts", -1).alias("name"), "is_leaf", F.coalesce("__parent", F.lit(-1)).alias("parent"))


def taxonomy_checks(nodes: DataFrame, max_depth: int = 6) -> DataFrame:
    """Counts, roots, and nodes that reach no root within ``max_depth`` steps."""
    up = nodes.select(F.col("node_id").alias("__n"), F.col("parent").alias("__p"))
    walk = nodes.select("node_id", F.col("parent").alias("at"), "is_leaf", "parent")
    for _ in range(max_depth - 1):
        walk = walk.join(up, F.col("at") == F.col("__n"), "left").select("node_id", "is_leaf", "parent", F.coalesce("__p", F.lit(-1)).alias("at"))
    return walk.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.expr("is_leaf")).alias("n_leaves"), F.count_if(F.expr("NOT is_leaf")).alias("n_internal"), F.count_if(F.expr("parent = -1")).alias("n_roots"), F.count_if(F.expr("at != -1")).alias("n_unrooted"))


def taxonomy_edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent >= 0").select(F.col("node_id").alias("child"), "parent", F.col("rank").alias("child_rank"))


def one_hot(code: Column, k: int, start: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(start), F.lit(start + k - 1)), lambda i: F.when(i == code, 1.0).otherwise(0.0))


def bipartite_edges(relative: DataFrame, clr: DataFrame) -> DataFrame:
    """One edge per present cell with a log weight and its CLR; a cell without CLR raises."""
    met = relative.filter("relative > 0").join(clr.select("sample", "taxon", "clr"), ["sample", "taxon"], "left")
    sure = F.when(F.col("clr").isNull(), F.raise_error(F.concat(F.lit("no CLR for "), "sample", F.lit(" "), "taxon")).cast("double")).otherwise(F.col("clr"))
    return met.select("sample", "taxon", edge_weight(F.col("relative")).alias("weight"), sure.alias("clr"))


def degrees(edges: DataFrame, spine: DataFrame | None = None, key: str = "sample") -> DataFrame:
    """Edges per node; nodes of ``spine`` without any have 0."""
    d = edges.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    return d if spine is None else spine.select(key).distinct().join(d, key, "left").na.fill(0, ["degree"])


def knn(vectors: DataFrame, k: int = 10, id_col: str = "sample", vec: str = "vec", block: int = 512, all_pairs: int = 5_000) -> DataFrame:
    """Exact ``k`` nearest others of each row, ``(src, dst, dist, place)``; ties by id.

    Over ``all_pairs`` rows go through the pivot index (``neighbours``).  Fewer are dealt into
    blocks: every pair of blocks is one Arrow task that keeps the best ``k`` per row and
    block, and the few kept are ranked."""
    import numpy as np
    import pandas as pd

    n = vectors.count()
    if n > all_pairs:
        from .neighbours import PivotIndex

        return PivotIndex(vectors, id_col, vec, k).nearest()
    blocks = max(1, -(-n // block))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = rows.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    pairs = packed.select(F.col("b").alias("b1"), F.col("rows").alias("r1")).join(packed.select(F.col("b").alias("b2"), F.col("rows").alias("r2")))
    kind = rows.schema["id"].dataType.simpleString()

    def nearest(batches):
        for pdf in batches:
            for r1, r2 in zip(pdf["r1"], pdf["r2"], strict=True):
                a, b = (np.array([np.asarray(x["v"], float) for x in r]) for r in (r1, r2))
                ia, ib = ([x["id"] for x in r] for r in (r1, r2))
                out = []
                for i, u in enumerate(a):  # differences, not a dot product: exact ties stay ties
                    d = np.sqrt(((b - u) ** 2).sum(axis=1))
                    at = np.argpartition(d, min(k, len(d) - 1))[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    at = np.flatnonzero(d <= d[at].max())
                    out += [(ia[i], ib[j], float(d[j])) for j in at if ib[j] != ia[i]]
                yield pd.DataFrame(out, columns=["src", "dst", "dist"])

    found = pairs.repartition(min(4096, blocks * blocks)).mapInPandas(nearest, f"src {kind}, dst {kind}, dist double")
    w = Window.partitionBy("src").orderBy(F.round("dist", 9), "dst")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def knn_edges(neighbours: DataFrame, groups: DataFrame | None = None, id_col: str = "sample", group: str = "project", drop_same: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Symmetric distinct edges with weight 1 / (1 + d); with ``groups`` also whether both
    ends share one, and (before symmetrising) the share of edges that do."""
    share = None
    both = neighbours.select("src", "dst", "dist").unionByName(neighbours.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    edges = both.groupBy("src", "dst").agg(F.min("dist").alias("dist")).withColumn("weight", 1 / (1 + F.col("dist")))
    if groups is not None:
        a = groups.select(F.col(id_col).alias("src"), F.col(group).alias("__a"))
        b = groups.select(F.col(id_col).alias("dst"), F.col(group).alias("__b"))
        same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
        share = neighbours.join(a, "src").join(b, "dst").agg(F.avg(same.cast("double")).alias("pct_same"), F.count(F.lit(1)).alias("n"))
        edges = edges.join(a, "src").join(b, "dst").withColumn("same_project", same).drop("__a", "__b")
        if drop_same:
            edges = edges.filter("NOT same_project")
    return edges, share


def label_agreement(edges: DataFrame, labels: DataFrame, id_col: str = "sample", label: str = "y") -> DataFrame:
    """Share of edges whose ends have the same 0/1 label, beside chance p^2 + (1 - p)^2."""
    a, b = labels.select(F.col(id_col).alias("src"), F.col(label).alias("__a")), labels.select(F.col(id_col).alias("dst"), F.col(label).alias("__b"))
    chance = labels.agg(F.avg(F.col(label).cast("double")).alias("p"))
    got = edges.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("n_edges"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("agreement"))
    return got.join(F.broadcast(chance)).select("n_edges", "agreement", (F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))).alias("chance"))


def sample_features(depths: DataFrame) -> DataFrame:
    return depths.select("sample", F.array(F.log10("depth"), F.col("n_nonzero").cast("double")).alias("features"))


def allowed_features(columns: Sequence[str], allowed: Sequence[str]) -> None:
    """Node features may hold technical facts only."""
    wrong = sorted(set(columns) - set(allowed))
    if wrong:
        raise ValueError(f"features that aren't allowed: {wrong}")


def leaf_statistics(counts: DataFrame, clr: DataFrame, zeros: DataFrame, train: DataFrame) -> DataFrame:
    """Per taxon over training samples: log10 prevalence (half a sample at least) and mean
    CLR, absent cells included."""
    t = train.select("sample").distinct()
    n = zeros.join(t, "sample", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("zero_clr").alias("z"))
    met = clr.join(t, "sample", "left_semi").join(zeros, "sample").groupBy("taxon").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("clr") - F.col("zero_clr")).alias("d"))
    taxa = counts.select("taxon").distinct()
    share = F.greatest(F.coalesce("k", F.lit(0)) / F.col("n"), F.lit(0.5) / F.col("n"))
    return taxa.join(met, "taxon", "left").join(F.broadcast(n)).select("taxon", F.log10(share).alias("log10_prevalence"), ((F.col("z") + F.coalesce("d", F.lit(0.0))) / F.col("n")).alias("mean_clr"))


def group_shares(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Share of each level of each column within a group; null is ``unknown``."""
    long = df.filter(F.col(group).isNotNull()).select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("level")) for c in columns))).alias("e")).select(group, "e.*")
    n = long.groupBy(group, "covariate", "level").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group, "covariate"))).drop("n")


def assemble(variant: str, abundance: DataFrame, taxonomy: DataFrame | None = None, neighbours: DataFrame | None = None, projects: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Typed edges ``(src_type, rel, dst_type, src, dst, weight)`` of a graph variant: G1
    abundance and taxonomy, G2 with sample neighbours, G3 with project nodes.  What a
    variant needs must be given, and nothing else."""
    needs = {"G1": (False, False), "G2": (True, False), "G3": (False, True)}
    if variant not in needs:
        raise ValueError(f"no graph variant {variant!r}")
    if (neighbours is not None, projects is not None) != needs[variant]:
        raise ValueError(f"{variant} needs " + ("neighbours" if needs[variant][0] else "projects" if needs[variant][1] else "neither neighbours nor projects"))

    def typed(df, src_type, rel, dst_type, src, dst, weight):
        return df.select(F.lit(src_type).alias("src_type"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), weight.cast("double").alias("weight"))

    parts = [typed(abundance, "sample", "abundance", "taxon", "sample", "taxon", F.col("weight")), typed(abundance, "taxon", "rev_abundance", "sample", "taxon", "sample", F.col("weight"))]
    if taxonomy is not None:
        parts += [typed(taxonomy, "taxon", "child_of", "taxon", "child", "parent", F.lit(1.0)), typed(taxonomy, "taxon", "parent_of", "taxon", "parent", "child", F.lit(1.0))]
    if neighbours is not None:
        parts.append(typed(neighbours, "sample", "similar_to", "sample", "src", "dst", F.col("weight")))
    if projects is not None:
        parts += [typed(projects, "sample", "from", "project", "sample", "project", F.lit(1.0)), typed(projects, "project", "rev_from", "sample", "project", "sample", F.lit(1.0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def induced(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges none of whose sample ends lies outside ``samples``."""
    keep = samples.select(F.col("sample").cast("string").alias("__s"), F.lit(True).alias("__in")).distinct()
    a, b = keep.select(F.col("__s").alias("src"), F.col("__in").alias("__a")), keep.select(F.col("__s").alias("dst"), F.col("__in").alias("__b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter("(src_type != 'sample' OR __a) AND (dst_type != 'sample' OR __b)").select(edges.columns)


def receivers_only(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Without edges whose source is a sample outside training: held-out samples receive
    messages and send none."""
    keep = train.select(F.col("sample").cast("string").alias("src")).distinct().withColumn("__in", F.lit(True))
    return edges.join(keep, "src", "left").filter("src_type != 'sample' OR __in").select(edges.columns)


def neighbour_sample(edges: DataFrame, fanout: dict[str, int], seed: int = 42, default: int = -1) -> DataFrame:
    """At most ``fanout[rel]`` incoming edges per node and relation, in hash order; -1 takes
    all."""
    w = Window.partitionBy("rel", "dst_type", "dst").orderBy(hash_order(seed, F.col("rel"), F.col("src"), F.col("dst")), "src")
    limit = F.lit(default)
    for rel, k in fanout.items():
        limit = F.when(F.col("rel") == rel, F.lit(k)).otherwise(limit)
    return edges.withColumn("__k", F.row_number().over(w)).withColumn("__m", limit).filter("__m < 0 OR __k <= __m").drop("__k", "__m")


def propagate(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One round of weighted-mean messages: per target and relation the mean of weight times
    source value, summed over relations, for ``vertices (type, id, dim, value)``.  Types
    without incoming edges keep no message; join them back as needed."""
    met = edges.join(vertices.select(F.col("type").alias("src_type"), F.col("id").alias("src"), "dim", "value"), ["src_type", "src"])
    per = met.groupBy("dst_type", "dst", "rel", "dim").agg(F.avg(F.col("weight") * F.col("value")).alias("m"))
    return per.groupBy(F.col("dst_type").alias("type"), F.col("dst").alias("id"), "dim").agg(F.sum("m").alias("message"))


def combine(vertices: DataFrame, messages: DataFrame, own: float = 1.0, incoming: float = 1.0) -> DataFrame:
    """``own`` times the value plus ``incoming`` times its message (0 without one)."""
    return vertices.join(messages, ["type", "id", "dim"], "left").select("type", "id", "dim", (F.lit(own) * F.col("value") + F.lit(incoming) * F.coalesce("message", F.lit(0.0))).alias("value"))


def normalised_adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Weights w / sqrt(d_src d_dst) with weighted degrees, as graph convolutions use."""
    d = edges.groupBy(dst).agg(F.sum("weight").alias("d"))
    return edges.join(d.select(F.col(dst).alias(src), F.col("d").alias("__a")), src).join(d.select(dst, F.col("d").alias("__b")), dst).withColumn("weight", F.col("weight") / F.sqrt(F.col("__a") * F.col("__b"))).drop("__a", "__b")


def pool(vertices: DataFrame, graph: str = "graph") -> DataFrame:
    """Mean and largest value over the nodes of each graph and dimension."""
    return vertices.groupBy(graph, "dim").agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))


def scale_features(vertices: DataFrame, train: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Standardised by mean and sample deviation (floored) of training nodes."""
    s = vertices.join(train.select("id").distinct(), "id", "left_semi").groupBy("type", "dim").agg(F.avg("value").alias("m"), F.greatest(F.lit(floor), F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("s"))
    return vertices.join(F.broadcast(s), ["type", "dim"]).select("type", "id", "dim", ((F.col("value") - F.col("m")) / F.col("s")).alias("value"))


def label_features(samples: DataFrame, train_labels: DataFrame, label: str = "y") -> DataFrame:
    """Per sample whether its label is known (training), and the label or 0."""
    known = train_labels.select("sample", F.col(label).cast("double").alias("__y"))
    return samples.select("sample").join(known, "sample", "left").select("sample", F.col("__y").isNotNull().cast("double").alias("known"), F.coalesce("__y", F.lit(0.0)).alias("label_value"))


def sample_graphs(values: DataFrame, zeros: DataFrame, nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Per-sample graphs on one shared skeleton: leaf features (CLR, present, log10
    prevalence), zeros at inner nodes.  ``nodes (node_id, taxon or null)``."""
    grid = zeros.join(F.broadcast(nodes.select("node_id", "taxon")))
    met = grid.join(values.select("sample", "taxon", "clr"), ["sample", "taxon"], "left").join(stats.select("taxon", "log10_prevalence"), "taxon", "left")
    leaf = F.col("taxon").isNotNull()
    return met.select("sample", "node_id", F.array(F.when(leaf, F.coalesce("clr", "zero_clr")).otherwise(0.0), F.when(leaf, F.col("clr").isNotNull().cast("double")).otherwise(0.0), F.when(leaf, F.coalesce("log10_prevalence", F.lit(0.0))).otherwise(0.0)).alias("features"))


def shuffled_parents(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """A tree of the same shape: parents permuted among nodes of a rank."""
    from .sampling import permute_within

    return permute_within(nodes.select("node_id", "rank", "parent"), ["rank"], "node_id", "parent", seed)


def same_label_edges(labels: DataFrame, per_node: int = 1, seed: int = 42, id_col: str = "sample", label: str = "y") -> DataFrame:
    """Rigged edges between samples of one label: each to the next ``per_node`` of its label
    in hash order (a ring), so none needs all pairs."""
    w = Window.partitionBy(label).orderBy(hash_order(seed, F.col(id_col)), id_col)
    placed = labels.select(id_col, label, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(label)).alias("n"))
    steps = placed.select(F.col(id_col).alias("src"), label, "n", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("s"), "i").withColumn("j", (F.col("i") + F.col("s")) % F.col("n"))
    return steps.join(placed.select(F.col(id_col).alias("dst"), F.col(label), F.col("i").alias("j")), [label, "j"]).filter("src != dst").select("src", "dst")


def matched_width(n_in: int, n_out: int, target: int, tolerance: float = 0.05) -> int:
    """Width h of two equal hidden layers whose parameters h^2 + (in + out + 2) h + out come
    nearest to ``target``; off by more than ``tolerance`` raises."""
    b = n_in + n_out + 2
    h = max(1, round((-b + (b * b + 4 * (target - n_out)) ** 0.5) / 2)) if target > n_out else 1
    if abs(h * h + b * h + n_out - target) > tolerance * target:
        raise ValueError("no width comes near the target")
    return h
