"""Registered queries: graphs and propagation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..operators import compose as C
from ..operators import counts as N
from ..operators import graphs as G
from ..operators import neighbours as NB
from . import views as V
from .queries_data import CLR, r6, rounded
from .views import COUNTS, SAMPLES, VECTORS

_TREE = """leaf AS (SELECT DISTINCT p_type || '.' || p_brand AS full_string, p_type AS a FROM part), pos AS (SELECT *, row_number() OVER (ORDER BY full_string) - 1 AS node_id FROM leaf),
inn AS (SELECT a, row_number() OVER (ORDER BY a) - 1 + (SELECT count(*) FROM leaf) AS node_id FROM (SELECT DISTINCT a FROM leaf)),
nodes AS (SELECT CAST(p.node_id AS INT) AS node_id, full_string AS lineage, 2 AS rank, TRUE AS is_leaf, CAST(i.node_id AS INT) AS parent FROM pos p JOIN inn i USING (a) UNION ALL SELECT CAST(node_id AS INT), a, 1, FALSE, -1 FROM inn)"""


def _nodes(spark, d):
    leaves = V.load(spark, d, "part").select(F.concat_ws(".", "p_type", "p_brand").alias("full")).distinct()
    leaves = leaves.select((F.row_number().over(Window.orderBy("full")) - 1).alias("pos"), F.split("full", "[.]").alias("parts"))
    return G.taxonomy_nodes(leaves)


@query(f"WITH {_TREE} SELECT node_id, lineage, CAST(rank AS INT) AS rank, is_leaf, parent FROM nodes")
def taxonomy_forest(spark, d):
    return _nodes(spark, d).select("node_id", F.array_join("parts", ".").alias("lineage"), "rank", "is_leaf", "parent")


@query(f"WITH {_TREE} SELECT count(*) AS n_nodes, count(*) FILTER (WHERE is_leaf) AS n_leaves, count(*) FILTER (WHERE NOT is_leaf) AS n_internal, count(*) FILTER (WHERE parent = -1) AS n_roots, CAST(0 AS BIGINT) AS n_unrooted FROM nodes")
def taxonomy_check(spark, d):
    return G.taxonomy_checks(_nodes(spark, d))


@query(f"""WITH {_TREE}, a AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY node_id) AS k FROM nodes), b AS (SELECT rank, parent AS v, row_number() OVER (PARTITION BY rank ORDER BY md5('42|' || CAST(node_id AS VARCHAR)), node_id) AS k FROM nodes)
SELECT node_id, CAST(a.rank AS INT) AS rank, v AS parent FROM a JOIN b ON a.rank = b.rank AND a.k = b.k""")
def shuffle_taxonomy(spark, d):
    return G.shuffled_parents(_nodes(spark, d))


_BIP = f"{COUNTS}, {CLR}, bip AS (SELECT sample, taxon, ln(1 + n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) * 10000) AS weight, clr FROM counts JOIN clr USING (sample, taxon))"


def _bipartite(spark, d):
    counts = V.counts(spark, d)
    return G.bipartite_edges(C.relative_abundance(counts), C.clr(counts)[0])


@query(f"WITH {_BIP} SELECT sample, taxon, round(weight, 6) AS weight, round(clr, 6) + 0.0 AS clr FROM bip")
def bipartite_edges(spark, d):
    return rounded(_bipartite(spark, d), "weight", "clr")


@query(f"WITH {COUNTS}, {SAMPLES} SELECT s.sample, coalesce(g, 0) AS degree FROM samples s LEFT JOIN (SELECT sample, count(*) AS g FROM counts GROUP BY 1) USING (sample)")
def node_degrees(spark, d):
    return G.degrees(N.presence(V.counts(spark, d)), V.samples(spark, d))


@query(f"""WITH {COUNTS}, {CLR}, tr AS (SELECT sample FROM zeros WHERE CAST(sample AS INT) % 5 > 0), n AS (SELECT count(*) AS n, sum(zero_clr) AS z FROM zeros WHERE sample IN (SELECT sample FROM tr)),
m AS (SELECT taxon, count(*) AS k, sum(clr - zero_clr) AS d FROM clr JOIN zeros USING (sample) WHERE sample IN (SELECT sample FROM tr) GROUP BY 1)
SELECT taxon, round(log10(greatest(coalesce(k, 0) / CAST(n AS DOUBLE), CAST(0.5 AS DOUBLE) / n)), 6) AS log10_prevalence, round((z + coalesce(d, 0)) / n, 6) AS mean_clr FROM (SELECT DISTINCT taxon FROM counts) LEFT JOIN m USING (taxon), n""")
def leaf_stats(spark, d):
    counts = V.counts(spark, d)
    values, zeros, _ = C.clr(counts)
    return rounded(G.leaf_statistics(counts, values, zeros, zeros.filter("CAST(sample AS INT) % 5 > 0")), "log10_prevalence", "mean_clr")


@query(f"""WITH {SAMPLES}, l AS (SELECT project, 'nation' AS covariate, nation AS level FROM samples UNION ALL SELECT project, 'disease_category', CASE WHEN disease_category = 'BUILDING' THEN 'unknown' ELSE disease_category END FROM samples), c AS (SELECT project, covariate, level, count(*) AS n FROM l GROUP BY ALL)
SELECT project, covariate, level, round(n / CAST(sum(n) OVER (PARTITION BY project, covariate) AS DOUBLE), 6) AS share FROM c""")
def project_shares(spark, d):
    s = V.samples(spark, d).withColumn("disease_category", F.nullif("disease_category", F.lit("BUILDING")))
    return rounded(G.group_shares(s, "project", ["nation", "disease_category"]), "share")


_KNN = f"""{VECTORS}, dd AS (SELECT x.sample AS src, y.sample AS dst, sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM vectors x JOIN vectors y ON x.sample <> y.sample),
nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS place FROM dd QUALIFY place <= 10),
sy AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM nn UNION ALL SELECT dst, src, dist FROM nn) GROUP BY 1, 2)"""


@query(f"WITH {_KNN} SELECT s.src, s.dst, round(dist, 6) AS dist, round(1 / (1 + dist), 6) AS weight, a.project = b.project AS same_project FROM sy s JOIN vectors a ON a.sample = s.src JOIN vectors b ON b.sample = s.dst")
def knn_edges(spark, d):
    v = V.vectors(spark, d)
    return rounded(G.knn_edges(G.knn(v), v)[0], "dist", "weight").select("src", "dst", "dist", "weight", "same_project")


@query(f"WITH {_KNN} SELECT round(avg(CAST(a.project = b.project AS DOUBLE)), 6) AS pct_same, count(*) AS n FROM nn JOIN vectors a ON a.sample = src JOIN vectors b ON b.sample = dst")
def knn_same_project(spark, d):
    v = V.vectors(spark, d)
    return rounded(G.knn_edges(G.knn(v), v)[1], "pct_same")


@query(f"WITH {_KNN} SELECT src, dst, round(dist, 6) AS dist, CAST(place AS INTEGER) AS place FROM nn")
def knn_index(spark, d):
    return rounded(NB.PivotIndex(V.vectors(spark, d)).nearest(), "dist")


@query()
def knn_index_recall(spark, d):
    """What searches of a few cells find of the exact neighbours, and what they look at."""
    index = NB.PivotIndex(V.vectors(spark, d))
    exact, out = index.nearest(), None
    for probes in (4, 8, 16):
        one = NB.recall(index.nearest(probes), exact).crossJoin(index.candidates(probes).select("mean", "most")).select(F.lit(probes).alias("probes"), "n", "recall", "mean", "most")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_KNN}, y AS (SELECT sample, CAST(project < 5 AS INT) AS y FROM vectors), p AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM y)
SELECT count(*) AS n_edges, round(avg(CAST(a.y = b.y AS DOUBLE)), 6) AS agreement, round(min(p * p + (1 - p) * (1 - p)), 6) AS chance FROM nn JOIN y a ON a.sample = src JOIN y b ON b.sample = dst, p""")
def knn_label_agreement(spark, d):
    v = V.vectors(spark, d)
    return rounded(G.label_agreement(G.knn(v), v.select("sample", (F.col("project") < 5).cast("int").alias("y"))), "agreement", "chance")


# Typed edges between samples, taxa and nations.
_EDGES = f"""{COUNTS}, {SAMPLES}, bp AS (SELECT sample, taxon, n / CAST(100 AS DOUBLE) AS w FROM counts),
edges AS (SELECT 'sample' AS src_type, 'abundance' AS rel, 'taxon' AS dst_type, sample AS src, taxon AS dst, w AS weight FROM bp UNION ALL SELECT 'taxon', 'rev_abundance', 'sample', taxon, sample, w FROM bp
  UNION ALL SELECT 'sample', 'from', 'project', sample, nation, 1.0 FROM samples UNION ALL SELECT 'project', 'rev_from', 'sample', nation, sample, 1.0 FROM samples)"""


def _edges(spark, d):
    a = V.counts(spark, d).select("sample", "taxon", (F.col("n") / 100.0).alias("weight"))
    return G.assemble("G3", a, projects=V.samples(spark, d).select("sample", F.col("nation").alias("project")))


@query(f"WITH {_EDGES} SELECT src_type, rel, dst_type, src, dst, round(CAST(weight AS DOUBLE), 6) AS weight FROM edges")
def typed_edges(spark, d):
    return rounded(_edges(spark, d), "weight")


_TRAIN = "tr AS (SELECT sample FROM samples WHERE row_id % 3 > 0)"


def _train(spark, d):
    return V.samples(spark, d).filter("row_id % 3 > 0").select("sample")


@query(f"WITH {_EDGES}, {_TRAIN} SELECT src_type, rel, dst_type, src, dst FROM edges WHERE (src_type <> 'sample' OR src IN (SELECT sample FROM tr)) AND (dst_type <> 'sample' OR dst IN (SELECT sample FROM tr))")
def induced_subgraph(spark, d):
    return G.induced(_edges(spark, d), _train(spark, d)).drop("weight")


@query(f"WITH {_EDGES}, {_TRAIN} SELECT src_type, rel, dst_type, src, dst FROM edges WHERE src_type <> 'sample' OR src IN (SELECT sample FROM tr)")
def receivers_only(spark, d):
    return G.receivers_only(_edges(spark, d), _train(spark, d)).drop("weight")


@query(f"""WITH {_EDGES} SELECT rel, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY rel, dst_type, dst ORDER BY md5('42|' || rel || '|' || src || '|' || dst), src) AS k FROM edges) WHERE rel NOT IN ('abundance', 'rev_abundance') OR (rel = 'abundance' AND k <= 15) OR (rel = 'rev_abundance' AND k <= 3)""")
def neighbor_fanout(spark, d):
    return G.neighbour_sample(_edges(spark, d), {"abundance": 15, "rev_abundance": 3}).select("rel", "src", "dst")


_VERT = """vert AS (SELECT 'sample' AS type, sample AS id, 0 AS dim, c_acctbal / 1000 AS value FROM samples UNION ALL SELECT 'taxon', taxon, 0, CAST(length(taxon) AS DOUBLE) FROM (SELECT DISTINCT taxon FROM bp) UNION ALL SELECT 'project', nation, 0, CAST(length(nation) AS DOUBLE) FROM (SELECT DISTINCT nation FROM samples))"""


def _vertices(spark, d):
    s = V.samples(spark, d)
    t = V.counts(spark, d).select("taxon").distinct()
    row = lambda df, kind, c, v: df.select(F.lit(kind).alias("type"), F.col(c).alias("id"), F.lit(0).alias("dim"), v.cast("double").alias("value"))
    return row(s, "sample", "sample", F.col("c_acctbal") / 1000).unionByName(row(t, "taxon", "taxon", F.length("taxon"))).unionByName(row(s.select("nation").distinct(), "project", "nation", F.length("nation")))


@query(f"""WITH {_EDGES}, {_VERT}, m AS (SELECT dst_type, dst, rel, dim, avg(weight * value) AS m FROM edges JOIN vert ON src_type = type AND src = id GROUP BY ALL)
SELECT dst_type AS type, dst AS id, CAST(dim AS INT) AS dim, round(sum(m) + 1e-9, 6) + 0.0 AS message FROM m GROUP BY ALL""")
def message_pass_mean(spark, d):
    # Sums of fractions often end in a 5: the smallest bit more rounds such ties one way in all engines.
    return rounded(G.propagate(_edges(spark, d), _vertices(spark, d)).withColumn("message", F.col("message") + 1e-9), "message")


@query(f"""WITH {_EDGES}, {_VERT}, s AS (SELECT type, dim, avg(value) AS m, greatest(1e-6, coalesce(stddev_samp(value), 0)) AS sd FROM vert WHERE type <> 'sample' OR CAST(id AS INT) % 3 > 0 GROUP BY ALL)
SELECT type, id, CAST(dim AS INT) AS dim, round((value - m) / sd, 6) + 0.0 AS value FROM vert JOIN s USING (type, dim)""")
def scaled_features(spark, d):
    v = _vertices(spark, d)
    return rounded(G.scale_features(v, v.filter("CASE WHEN type = 'sample' THEN CAST(id AS INT) % 3 > 0 ELSE TRUE END")), "value")


@query(f"WITH {SAMPLES} SELECT sample, CAST(row_id % 3 > 0 AS DOUBLE) AS known, CASE WHEN row_id % 3 > 0 AND disease_label = 'case' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label_value FROM samples")
def label_features(spark, d):
    s = V.samples(spark, d)
    return G.label_features(s, s.filter("row_id % 3 > 0").select("sample", (F.col("disease_label") == "case").cast("int").alias("y")))


@query(f"WITH {_EDGES}, a AS (SELECT * FROM edges WHERE rel = 'abundance'), dd AS (SELECT dst, sum(weight) AS d FROM a GROUP BY 1), ds AS (SELECT src, sum(weight) AS d FROM a GROUP BY 1) SELECT src, a.dst, round(weight / sqrt(d), 6) AS weight FROM a JOIN dd USING (dst)")
def degree_normalised(spark, d):
    e = _edges(spark, d).filter("rel = 'abundance'")
    deg = e.groupBy("dst").agg(F.sum("weight").alias("d"))
    return e.join(deg, "dst").select("src", "dst", r6(F.col("weight") / F.sqrt("d")).alias("weight"))


@query(f"""WITH {SAMPLES}, o AS (SELECT sample, disease_label AS y, row_number() OVER (PARTITION BY disease_label ORDER BY md5('42|' || sample), sample) - 1 AS i, count(*) OVER (PARTITION BY disease_label) AS n FROM samples)
SELECT a.sample AS src, b.sample AS dst FROM o a, (VALUES (1), (2)) AS t(s), o b WHERE a.y = b.y AND b.i = (a.i + s) % a.n AND a.sample <> b.sample""")
def rigged_edges(spark, d):
    s = V.samples(spark, d).select("sample", F.col("disease_label").alias("y"))
    return G.same_label_edges(s, 2)


@query(f"""WITH {COUNTS}, {CLR}, nd AS (SELECT taxon, CAST(row_number() OVER (ORDER BY taxon) - 1 AS INT) AS node_id FROM (SELECT DISTINCT taxon FROM counts) UNION ALL SELECT NULL, (SELECT count(DISTINCT taxon) FROM counts))
SELECT sample, node_id, round(CASE WHEN nd.taxon IS NULL THEN 0 ELSE coalesce(clr, zero_clr) END, 6) + 0.0 AS f0, CAST(clr IS NOT NULL AS DOUBLE) AS f1 FROM zeros CROSS JOIN nd LEFT JOIN clr ON clr.sample = zeros.sample AND clr.taxon = nd.taxon""".replace("SELECT sample, node_id", "SELECT zeros.sample, node_id"))
def sample_graphs(spark, d):
    counts = V.counts(spark, d)
    values, zeros, _ = C.clr(counts)
    taxa = counts.select("taxon").distinct()
    leaves = taxa.select((F.row_number().over(Window.orderBy("taxon")) - 1).alias("node_id"), "taxon")
    nodes = leaves.unionByName(taxa.agg(F.count(F.lit(1)).cast("int").alias("node_id"), F.lit(None).cast("string").alias("taxon")))
    g = G.sample_graphs(values, zeros, nodes, taxa.withColumn("log10_prevalence", F.lit(0.0)))
    return g.select("sample", "node_id", r6(F.col("features")[0]).alias("f0"), F.col("features")[1].alias("f1"))
