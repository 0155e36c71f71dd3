"""Each operator applied to the driver's tables, with an independent DuckDB formulation where SQL has one.

Values are rounded to six decimals on both sides. The count dataset (suppliers x brand and type) feeds the negative
binomial operators, events the continuous ones and embeddings the clustering ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import census, cluster, differential, graph, models, normalize, plotdata, plots, preprocess, reduce, trajectory
from ..sources import from_embeddings, from_events, from_lineitem

A, B = 0.05, 1.0
DC, RHO, DELTA = 0.6, 1.0, 0.55
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

COUNTS = """
WITH RECURSIVE expr AS (
  SELECT l_suppkey AS cell_id, p_brand || '|' || p_type AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), cells AS (
  SELECT s_suppkey AS cell_id, s_nationkey % 3 AS grp, s_nationkey % 2 AS batch, s_acctbal AS pt
  FROM supplier WHERE s_suppkey IN (SELECT cell_id FROM expr)
), genes AS (SELECT DISTINCT gene_id, split_part(gene_id, '|', 2) AS gene_short_name FROM expr),
nc AS (SELECT count(*) AS n FROM cells),
tot AS (SELECT cell_id, sum(round_even(value, 0)) AS total FROM expr GROUP BY 1),
sf AS (SELECT cell_id, total / exp(avg(ln(total)) OVER ()) AS sf FROM tot),
dense AS (
  SELECT c.cell_id, g.gene_id, coalesce(e.value, 0) AS value FROM cells c CROSS JOIN genes g
  LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id
)"""

EVENTS = """
WITH expr AS (
  SELECT user_id AS cell_id, event_type || '|' || CAST(hour(ts) AS VARCHAR) AS gene_id, sum(value) AS value
  FROM events GROUP BY 1, 2
), tot AS (SELECT cell_id, sum(value) AS s FROM expr GROUP BY 1)"""

POINTS = """
WITH RECURSIVE p AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.cell_id <> b.cell_id),
rho AS MATERIALIZED (SELECT i AS cell_id, sum(exp(-power(d / 0.6, 2))) AS rho FROM d GROUP BY 1),
up AS MATERIALIZED (SELECT d.i, min(struct_pack(d := d.d, j := d.j)) AS u FROM d JOIN rho a ON a.cell_id = d.i JOIN rho b ON b.cell_id = d.j WHERE b.rho > a.rho GROUP BY 1),
far AS (SELECT i, min(struct_pack(d := -d, j := j)) AS u FROM d GROUP BY 1),
near AS MATERIALIZED (SELECT r.cell_id, r.rho, coalesce(up.u.d, -far.u.d) AS delta, coalesce(up.u.j, far.u.j) AS nearest, up.u IS NOT NULL AS has_denser
  FROM rho r LEFT JOIN up ON up.i = r.cell_id JOIN far ON far.i = r.cell_id)"""


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_LOADED: dict = {}


def counts(spark: SparkSession, d: str):
    """The dataset, its entries worked out once a session, as whoever analyses a dataset does."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOADED:
        cds = from_lineitem(spark, d)
        entries = cds.expr.persist()
        _LOADED.clear()
        _LOADED[key] = cds.with_(expr=entries, cells=cds.cells.persist(), genes=cds.genes.persist())
    return _LOADED[key]


def sized(spark: SparkSession, d: str):
    return preprocess.with_dispersion(preprocess.estimate_size_factors(counts(spark, d)), A, B)


def _size_factor(name: str, method: str, sql: str) -> None:
    query(f"size_factor_{name}", COUNTS + sql)(lambda s, d: preprocess.size_factors(counts(s, d), method).select("cell_id", r6("size_factor").alias("size_factor")))


_size_factor("default", "mean-geometric-mean-total", " SELECT cell_id, round(sf, 6) AS size_factor FROM sf")
_size_factor("geomtotal", "geometric-mean-total", " SELECT cell_id, round(ln(total) / avg(ln(total)) OVER (), 6) AS size_factor FROM tot")
_size_factor("medgeo", "median-geometric-mean", """, g AS (
  SELECT gene_id, avg(ln(round_even(value, 0))) AS m FROM expr, nc WHERE round_even(value, 0) > 0 GROUP BY gene_id, n HAVING count(*) = n)
SELECT c.cell_id, round(coalesce(s, 1.0), 6) AS size_factor FROM cells c LEFT JOIN (
  SELECT cell_id, exp(median(ln(round_even(value, 0)) - m)) AS s FROM expr JOIN g USING (gene_id) GROUP BY 1) z USING (cell_id)""")
_size_factor("wmedian", "weighted-median", """, g AS (
  SELECT gene_id, median(round_even(value, 0)) AS med, count(*) FILTER (round_even(value, 0) > 0) / count(*) AS w FROM dense GROUP BY 1)
SELECT c.cell_id, round(coalesce(s, 1.0), 6) AS size_factor FROM cells c LEFT JOIN (
  SELECT cell_id, exp(avg(w * (ln(round_even(value, 0)) - ln(med)))) AS s FROM expr JOIN g USING (gene_id)
  WHERE round_even(value, 0) > 0 AND med > 0 GROUP BY 1) z USING (cell_id)""")
_size_factor("median", "median", """, g AS (SELECT gene_id, median(round_even(value, 0)) AS med FROM dense GROUP BY 1)
SELECT cell_id, round(median(round_even(value, 0) - med), 6) AS size_factor FROM dense JOIN g USING (gene_id) GROUP BY 1""")


@query("detect_genes_gene", COUNTS + " SELECT g.gene_id, count(e.cell_id) AS num_cells_expressed FROM genes g LEFT JOIN expr e ON e.gene_id = g.gene_id AND e.value > 50 GROUP BY 1")
def _(s, d):
    return preprocess.detect_genes(counts(s, d), 50.0).genes.select("gene_id", "num_cells_expressed")


@query("detect_genes_cell", COUNTS + " SELECT c.cell_id, count(e.gene_id) AS num_genes_expressed FROM cells c LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.value > 50 GROUP BY 1")
def _(s, d):
    return preprocess.detect_genes(counts(s, d), 50.0).cells.select("cell_id", "num_genes_expressed")


@query("ordering_filter", COUNTS + ", top AS (SELECT gene_id FROM expr GROUP BY 1 HAVING avg(value) > 100) SELECT gene_id, gene_id IN (SELECT gene_id FROM top) AS use_for_ordering FROM genes")
def _(s, d):
    cds = counts(s, d)
    top = cds.expr.groupBy("gene_id").agg(F.avg("value").alias("m")).where("m > 100")
    return preprocess.set_ordering_filter(cds, top).genes.select("gene_id", "use_for_ordering")


@query("qc_filter", COUNTS + ", t AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1), b AS (SELECT avg(log10(total)) AS m, stddev_samp(log10(total)) AS s FROM t) SELECT cell_id, total FROM t, b WHERE abs(log10(total) - m) < 2 * s")
def _(s, d):
    return preprocess.qc_filter(counts(s, d))


MOMENTS = """, x AS (SELECT {by} gene_id, round_even(value, 0) / sf AS x, round_even(value, 0) AS r, sf FROM dense JOIN sf USING (cell_id) JOIN cells USING (cell_id)),
xim AS (SELECT {by} avg(1 / sf) AS xim FROM sf JOIN cells USING (cell_id) {grouped}),
mom AS (SELECT {by} gene_id, avg(x) AS mu, greatest(0, (var_pop(x) - any_value(xim) * avg(x)) / (avg(x) * avg(x))) AS disp
  FROM x {joined} GROUP BY ALL HAVING count(*) FILTER (r > 0.1) > 1)"""


@query("disp_moments", COUNTS + MOMENTS.format(by="", grouped="", joined=", xim") + " SELECT gene_id, round(mu, 6) AS mu, round(disp, 6) AS disp FROM mom")
def _(s, d):
    return preprocess.dispersion_moments(sized(s, d)).select("gene_id", r6("mu").alias("mu"), r6("disp").alias("disp"))


@query("disp_moments_grouped", COUNTS + MOMENTS.format(by="grp,", grouped="GROUP BY grp", joined="JOIN xim USING (grp)") + " SELECT grp, gene_id, round(mu, 6) AS mu, round(disp, 6) AS disp FROM mom")
def _(s, d):
    return preprocess.dispersion_moments(sized(s, d), by=["grp"]).select("grp", "gene_id", r6("mu").alias("mu"), r6("disp").alias("disp"))


@query("disp_table_fixed", COUNTS + MOMENTS.format(by="", grouped="", joined=", xim") + " SELECT gene_id, round(mu, 6) AS mean_expression, round(0.05 + 1.0 / mu, 6) AS dispersion_fit, round(disp, 6) AS dispersion_empirical FROM mom")
def _(s, d):
    cds = sized(s, d)
    t = preprocess.disp_table(cds, preprocess.dispersion_moments(cds))
    return t.select("gene_id", *(r6(c).alias(c) for c in t.columns[1:]))


VST = "log2((1 + 1.0 + 2 * 0.05 * {q} + 2 * sqrt(0.05 * {q} * (1 + 1.0 + 0.05 * {q}))) / (4 * 0.05))"


@query("vst_fixed", COUNTS + f" SELECT cell_id, gene_id, round({VST.format(q='round_even(value / sf, 0)')}, 6) AS value FROM expr JOIN sf USING (cell_id)")
def _(s, d):
    return preprocess.vst_exprs(sized(s, d)).select("cell_id", "gene_id", r6("value").alias("value"))


@query("norm_log", COUNTS + " SELECT cell_id, gene_id, round(log2(value / sf + 1), 6) AS value FROM dense JOIN sf USING (cell_id)")
def _(s, d):
    return normalize.normalize_expr(sized(s, d)).withColumn("value", r6("value"))


@query("norm_none", COUNTS + " SELECT cell_id, gene_id, round(value / sf + 1, 6) AS value FROM dense JOIN sf USING (cell_id)")
def _(s, d):
    return normalize.normalize_expr(sized(s, d), "none", relative_expr=False).withColumn("value", r6("value"))


@query("norm_vst", COUNTS + f" SELECT cell_id, gene_id, round({VST.format(q='(value / sf)')}, 6) AS value FROM dense JOIN sf USING (cell_id)")
def _(s, d):
    return normalize.normalize_expr(sized(s, d), "vstExprs").withColumn("value", r6("value"))


@query("norm_tobit_log", EVENTS + " SELECT c.cell_id, g.gene_id, round(log2(coalesce(e.value, 0) + 1), 6) AS value FROM (SELECT DISTINCT cell_id FROM expr) c CROSS JOIN (SELECT DISTINCT gene_id FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id")
def _(s, d):
    return normalize.normalize_expr(from_events(s, d)).withColumn("value", r6("value"))


@query("tfidf", COUNTS + ", df AS (SELECT gene_id, count(*) AS df FROM expr WHERE value > 0 GROUP BY 1) SELECT cell_id, gene_id, round(ln(1 + n / df), 6) AS value FROM expr JOIN df USING (gene_id), nc WHERE value > 0")
def _(s, d):
    return normalize.tf_idf(counts(s, d)).withColumn("value", r6("value"))


LOGS = ", l AS (SELECT cell_id, gene_id, log2(value / sf + 1) AS v FROM dense JOIN sf USING (cell_id))"


@query("zero_sd", COUNTS + ", b AS (SELECT cell_id, gene_id, CAST(value > 20 AS DOUBLE) AS value FROM dense), k AS (SELECT gene_id FROM b GROUP BY 1 HAVING stddev_pop(value) > 0) SELECT gene_id, count(*) AS n FROM b WHERE gene_id IN (SELECT gene_id FROM k) GROUP BY 1")
def _(s, d):
    x = counts(s, d).dense().withColumn("value", (F.col("value") > 20).cast("double"))
    return normalize.drop_zero_sd(x).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


@query("zscore", COUNTS + LOGS + " SELECT cell_id, gene_id, round((v - avg(v) OVER g) / stddev_samp(v) OVER g, 6) AS value FROM l WINDOW g AS (PARTITION BY gene_id)")
def _(s, d):
    return normalize.zscore(normalize.normalize_expr(sized(s, d))).withColumn("value", r6("value"))


@query("batch_residual", COUNTS + LOGS + ", m AS (SELECT gene_id, batch, avg(v) AS m FROM l JOIN cells USING (cell_id) GROUP BY 1, 2) SELECT l.cell_id, l.gene_id, round(v - (m.m - m0.m), 6) AS value FROM l JOIN cells USING (cell_id) JOIN m ON m.gene_id = l.gene_id AND m.batch = cells.batch JOIN m m0 ON m0.gene_id = l.gene_id AND m0.batch = (SELECT min(batch) FROM cells)")
def _(s, d):
    cds = sized(s, d)
    return normalize.batch_residual(normalize.normalize_expr(cds), cds.cells, "batch").withColumn("value", r6("value"))


FIXED_T = ", f AS (SELECT cell_id, CASE WHEN count(*) FILTER (value <= 60) > 0 THEN count(*) / 0.25 ELSE 0 END AS total FROM expr WHERE value > 0.1 GROUP BY 1)"


def _fixed_t(cds):
    return cds.cells.select("cell_id", F.lit(60.0).alias("t"))


@query("census_total_fixed_t", EVENTS + FIXED_T + " SELECT cell_id, CAST(total AS DOUBLE) AS total FROM f")
def _(s, d):
    cds = from_events(s, d)
    return census.total_proposal(cds, _fixed_t(cds))


@query("relative2abs_fixed_t", EVENTS + FIXED_T + " SELECT cell_id, gene_id, round(value / s * coalesce(f.total, 0), 6) AS value FROM expr JOIN tot USING (cell_id) LEFT JOIN f USING (cell_id)")
def _(s, d):
    cds = from_events(s, d)
    return census.relative2abs(cds, _fixed_t(cds)).withColumn("value", r6("value"))


@query("estimate_t")
def _(s, d):
    return census.estimate_t(from_events(s, d))


def _lrt(family: str, part: str, stat: str, y: str) -> None:
    sql = COUNTS + f""", y AS (SELECT gene_id, grp, {y} AS y, round_even(value, 0) AS raw FROM dense JOIN sf USING (cell_id) JOIN cells USING (cell_id)),
g AS (SELECT gene_id, grp, sum(y) AS s, sum(y * y) AS ss, count(*) AS n, sum(raw) AS raw FROM y GROUP BY 1, 2),
h AS (SELECT gene_id, sum(s) AS S_, sum(ss) AS SS_, sum(n) AS N_, sum(raw) AS R_ FROM g GROUP BY 1),
t AS (SELECT gene_id, sum({part}) AS v, any_value(S_) AS S_, any_value(SS_) AS SS_, any_value(N_) AS N_ FROM g JOIN h USING (gene_id) GROUP BY 1),
u AS (SELECT gene_id, greatest(0, {stat}) AS stat, exp(-greatest(0, {stat}) / 2) AS pval FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY pval) AS rn, count(*) OVER () AS m FROM u)
SELECT gene_id, round(stat, 6) AS stat, round(pval, 6) AS pval,
  round(least(1.0, min(pval * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS qval FROM r"""
    query(f"de_group_{family}", sql)(lambda s, d: differential.group_lrt(sized(s, d), "grp", family, *((A, B) if family == "nb" else ())).select("gene_id", *(r6(c).alias(c) for c in ("stat", "pval", "qval"))))


_X = "(CASE WHEN s = 0 THEN 0 ELSE s * ln({m}) END)"
_lrt("nb", "CASE WHEN R_ > 0 THEN 2 * (" + _X.format(m="s / n") + " - (s + n / (0.05 + 1.0 / (R_ / N_))) * ln(1 + (0.05 + 1.0 / (R_ / N_)) * s / n) - " + _X.format(m="S_ / N_") + " + (s + n / (0.05 + 1.0 / (R_ / N_))) * ln(1 + (0.05 + 1.0 / (R_ / N_)) * S_ / N_)) ELSE 0 END", "v", "round_even(value / sf, 0)")
_lrt("poisson", "2 * (" + _X.format(m="s / n") + " - " + _X.format(m="S_ / N_") + " - s + n * S_ / N_)", "v", "round_even(value / sf, 0)")
_lrt("gaussian", "ss - s * s / n", "N_ * ln((SS_ - S_ * S_ / N_) / v)", "value")
_F = "(CASE WHEN n = s THEN 0 ELSE (n - s) * ln(1 - {m}) END)"
_lrt("binomial", "2 * (" + _X.format(m="s / n") + " + " + _F.format(m="s / n") + " - " + _X.format(m="S_ / N_") + " - " + _F.format(m="S_ / N_") + ")", "v", "CAST(value > 0 AS DOUBLE)")


@query("bh_adjust", "WITH p AS (SELECT s_suppkey AS id, (abs(s_acctbal) + 1) / 100000 AS pval FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY pval) AS rn, count(*) OVER () AS m FROM p) SELECT id, round(least(1.0, min(pval * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS qval FROM r")
def _(s, d):
    t = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), ((F.abs("s_acctbal") + 1) / 100000).alias("pval"))
    return differential.bh_adjust(t).select("id", r6("qval").alias("qval"))


def rho(s, d) -> DataFrame:
    points = from_embeddings(s, d)
    return points.join(cluster.local_density(points, DC), "cell_id")


@query("rho_gauss", POINTS + " SELECT cell_id, round(rho, 6) AS rho FROM rho")
def _(s, d):
    return rho(s, d).select("cell_id", r6("rho").alias("rho"))


@query("rho_cutoff", POINTS + " SELECT i AS cell_id, CAST(count(*) FILTER (d < 1.2) AS DOUBLE) AS rho FROM d GROUP BY 1")
def _(s, d):
    return cluster.local_density(from_embeddings(s, d), 1.2, gaussian=False)


@query("pair_distance", POINTS + " SELECT label, count(*) AS n, round(sum(d), 6) AS total FROM d JOIN p ON p.cell_id = d.i GROUP BY 1")
def _(s, d):
    return cluster.distance_sums(from_embeddings(s, d)).select("label", "n", r6("total").alias("total"))


@query("delta_nearest", POINTS + " SELECT cell_id, round(delta, 6) AS delta, nearest FROM near")
def _(s, d):
    return cluster.nearest_denser(rho(s, d)).select("cell_id", r6("delta").alias("delta"), "nearest")


def peaked(s, d) -> DataFrame:
    points = rho(s, d).cache()
    return points.join(cluster.nearest_denser(points), "cell_id")


@query("peaks_threshold", POINTS + f" SELECT cell_id, rho > {RHO} AND delta > {DELTA} AS peaks FROM near")
def _(s, d):
    return peaked(s, d).select("cell_id", ((F.col("rho") > RHO) & (F.col("delta") > DELTA)).alias("peaks"))


CLUSTERS = f""", k AS MATERIALIZED (SELECT *, rho > {RHO} AND delta > {DELTA} AS peaks FROM near),
lab AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS label FROM k WHERE peaks),
walk(cell_id, pos) AS (SELECT cell_id, cell_id FROM k UNION ALL SELECT w.cell_id, k.nearest FROM walk w JOIN k ON k.cell_id = w.pos WHERE NOT k.peaks AND k.has_denser),
ends AS (SELECT w.cell_id, w.pos FROM walk w JOIN k ON k.cell_id = w.pos WHERE k.peaks OR NOT k.has_denser),
cl AS MATERIALIZED (SELECT e.cell_id, CAST(coalesce(lab.label, -1) AS INTEGER) AS cluster FROM ends e LEFT JOIN lab ON lab.cell_id = e.pos)"""


@query("cluster_labels", POINTS + CLUSTERS + " SELECT cell_id, cluster FROM cl")
def _(s, d):
    return cluster.assign_clusters(s, peaked(s, d), RHO, DELTA).select("cell_id", "cluster")


@query("halo", POINTS + CLUSTERS + ", b AS (SELECT x.cluster, max((r.rho + q.rho) / 2) AS border FROM d JOIN cl x ON x.cell_id = d.i JOIN cl y ON y.cell_id = d.j AND y.cluster <> x.cluster AND y.cluster <> -1 AND x.cluster <> -1 JOIN rho r ON r.cell_id = d.i JOIN rho q ON q.cell_id = d.j WHERE d <= 0.6 GROUP BY 1) SELECT r.cell_id, cluster <> -1 AND r.rho < coalesce(b.border, 0) AS halo FROM rho r JOIN cl USING (cell_id) LEFT JOIN b USING (cluster)")
def _(s, d):
    return cluster.halo(cluster.assign_clusters(s, peaked(s, d), RHO, DELTA), DC)


NODES = ", c AS (SELECT label AS node, [avg(v[i]) FOR i IN range(1, 65)] AS c FROM p GROUP BY 1)"


def centres(points: DataFrame) -> DataFrame:
    long = points.select("label", F.posexplode("coords").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return long.groupBy(F.col("label").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("coords"))


@query("nearest_node", "WITH p AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT label AS node, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM p), m AS (SELECT node, i, avg(x) AS x FROM q GROUP BY 1, 2), c AS (SELECT node, list(x ORDER BY i) AS v FROM m GROUP BY 1), n AS (SELECT p.cell_id, min(struct_pack(d := list_distance(p.v, c.v), node := c.node)) AS u FROM p CROSS JOIN c GROUP BY 1) SELECT cell_id, CAST(u.node AS BIGINT) AS node, round(u.d, 6) AS distance FROM n")
def _(s, d):
    points = from_embeddings(s, d)
    return cluster.nearest_node(points, centres(points)).select("cell_id", "node", r6("distance").alias("distance"))


# a tree over customers: each hangs from the one at half its key, edges as long as the difference of keys
TREE = "WITH RECURSIVE e AS (SELECT c_custkey // 2 AS src, c_custkey AS dst, c_custkey - c_custkey // 2 AS weight FROM customer WHERE c_custkey > 1), "


def tree(s, d) -> DataFrame:
    k = F.col("c_custkey")
    half = F.floor(k / 2).cast("long")
    return s.read.parquet(f"{d}/customer.parquet").where("c_custkey > 1").select(half.alias("src"), k.alias("dst"), (k - half).cast("double").alias("weight"))


@query("tree_degree", TREE + "b AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM b GROUP BY 1")
def _(s, d):
    return graph.degree(tree(s, d))


@query("tree_pseudotime", TREE + "t(node, pseudotime) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION ALL SELECT e.dst, t.pseudotime + e.weight FROM t JOIN e ON e.src = t.node) SELECT node, pseudotime FROM t")
def _(s, d):
    return graph.pseudotime(tree(s, d), 1)


@query("tree_path", TREE + "m AS (SELECT max(dst) AS top FROM e), t(node, step) AS (SELECT top, CAST(0 AS BIGINT) FROM m UNION ALL SELECT e.src, t.step + 1 FROM t JOIN e ON e.dst = t.node) SELECT node, step FROM t")
def _(s, d):
    return graph.path_to_root(tree(s, d), s.read.parquet(f"{d}/customer.parquet").agg(F.max("c_custkey")).first()[0])


@query("branch_ancestors", TREE + "t(leaf, node) AS (SELECT CAST(x AS BIGINT), CAST(x AS BIGINT) FROM (VALUES (37), (75)) v(x) UNION ALL SELECT t.leaf, e.src FROM t JOIN e ON e.dst = t.node) SELECT node FROM t GROUP BY 1 HAVING count(DISTINCT leaf) = 2")
def _(s, d):
    e = tree(s, d)
    return graph.path_to_root(e, 37).select("node").intersect(graph.path_to_root(e, 75).select("node"))


CELLS = "WITH c AS (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS grp, s_acctbal AS pt FROM supplier)"


def branch_cells(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 3).alias("grp"), F.col("s_acctbal").alias("pt"))


@query("branch_alternate", CELLS + ", a AS (SELECT cell_id, (row_number() OVER (ORDER BY pt, cell_id) - 1) % 2 AS k FROM c WHERE grp = 0) SELECT cell_id, CASE k WHEN 0 THEN 'Y_1' ELSE 'Y_2' END AS branch FROM a UNION ALL SELECT cell_id, 'Y_' || CAST(grp AS VARCHAR) FROM c WHERE grp > 0 UNION ALL (SELECT cell_id, 'Y_2' FROM c WHERE grp = 0 ORDER BY pt, cell_id LIMIT 1)")
def _(s, d):
    c = branch_cells(s, d)
    return graph.sequential_split(c.where("grp = 0"), c.where("grp > 0").select("cell_id", F.concat(F.lit("Y_"), F.col("grp").cast("string")).alias("branch")), ["Y_1", "Y_2"])


@query("branch_duplicate", CELLS + " SELECT 'duplicate_' || b || '_' || cell_id AS cell_id, cell_id AS original_cell_id, 'Y_' || b AS branch FROM c, (VALUES (1), (2)) v(b) WHERE grp = 0 UNION ALL SELECT CAST(cell_id AS VARCHAR), cell_id, 'Y_' || grp FROM c WHERE grp > 0")
def _(s, d):
    c = branch_cells(s, d)
    return graph.duplicate_progenitors(c.where("grp = 0"), c.where("grp > 0").select("cell_id", F.concat(F.lit("Y_"), F.col("grp").cast("string")).alias("branch")), ["Y_1", "Y_2"])


@query("branch_rescale", CELLS + " SELECT cell_id, grp, round(CASE WHEN max(pt) OVER g > min(pt) OVER g THEN 100 * (pt - min(pt) OVER g) / (max(pt) OVER g - min(pt) OVER g) ELSE pt END, 6) AS pt FROM c WINDOW g AS (PARTITION BY grp)")
def _(s, d):
    return plotdata.rescale(branch_cells(s, d), "grp", "pt").select("cell_id", "grp", r6("pt").alias("pt"))


@query("branch_stretch", CELLS + ", a AS (SELECT cell_id, grp, pt - min(pt) OVER () AS pt FROM c), p AS (SELECT max(pt) FILTER (grp = 0) AS top FROM a), l AS (SELECT grp, max(pt) AS m FROM a WHERE grp > 0 GROUP BY 1), x AS (SELECT greatest(max(m), (SELECT top FROM p)) AS longest FROM l), z AS (SELECT cell_id, a.grp, CASE WHEN a.grp > 0 AND pt > top AND m > top THEN top + (pt - top) * (longest - top) / (m - top) ELSE pt END AS pt FROM a LEFT JOIN l ON l.grp = a.grp, p, x) SELECT cell_id, grp, round(pt * 100 / max(pt) OVER (), 6) AS pt FROM z")
def _(s, d):
    c = branch_cells(s, d)
    low = c.agg(F.min("pt").alias("low"))
    c = c.crossJoin(F.broadcast(low)).withColumn("pt", F.col("pt") - F.col("low")).drop("low")
    return graph.stretch(c, F.col("grp") == 0, "grp", "pt").select("cell_id", "grp", r6("pt").alias("pt"))


CURVES = COUNTS + ", c AS (SELECT gene_id, batch, grp AS point_idx, avg(value) AS e FROM dense JOIN cells USING (cell_id) GROUP BY 1, 2, 3), w AS (SELECT gene_id, point_idx, max(e) FILTER (batch = 0) AS a, max(e) FILTER (batch = 1) AS b FROM c GROUP BY 1, 2)"


def curves(s, d) -> DataFrame:
    cds = counts(s, d)
    x = cds.dense().join(cds.cells.select("cell_id", "batch", "grp"), "cell_id")
    e = x.groupBy("gene_id", F.col("grp").alias("point_idx"), "batch").agg(F.avg("value").alias("e"))
    return e.groupBy("gene_id", "point_idx").agg(F.max(F.when(F.col("batch") == 0, F.col("e"))).alias("a"), F.max(F.when(F.col("batch") == 1, F.col("e"))).alias("b"))


@query("ilr_fixed", CURVES + " SELECT gene_id, point_idx, round(greatest(-3, least(3, log2((a + 1) / (b + 1)))), 6) AS ilr FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def _(s, d):
    return plotdata.log_ratio(curves(s, d).dropna(), 3.0).select("gene_id", "point_idx", r6("ilr").alias("ilr"))


@query("abc_trapezoid", CURVES + ", q AS (SELECT gene_id, point_idx, a - b AS d FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT gene_id, round((sum(d) - (arg_min(d, point_idx) + arg_max(d, point_idx)) / 2) * 100 / (count(*) - 1), 3) AS abc FROM q GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return plotdata.area_between(curves(s, d).dropna())


@query("expr_long", COUNTS + " SELECT gene_id AS f_id, cell_id AS cell, round_even(value / sf, 0) AS expression FROM dense JOIN sf USING (cell_id)")
def _(s, d):
    return plotdata.expression_long(sized(s, d))


@query("marker_semi", COUNTS + " SELECT gene_id, gene_short_name FROM genes WHERE gene_short_name = (SELECT min(gene_short_name) FROM genes) OR gene_id = (SELECT max(gene_id) FROM genes)")
def _(s, d):
    cds = counts(s, d)
    wanted = cds.genes.agg(F.min("gene_short_name").alias("m")).union(cds.genes.agg(F.max("gene_id").alias("m")))
    return plotdata.markers(cds, wanted).select("gene_id", "gene_short_name")


@query("row_scale_clip", COUNTS + LOGS + " SELECT cell_id, gene_id, round(greatest(-1.5, least(1.5, (v - avg(v) OVER g) / stddev_samp(v) OVER g)), 6) AS value FROM l WINDOW g AS (PARTITION BY gene_id)")
def _(s, d):
    return plotdata.row_scale_clip(normalize.normalize_expr(sized(s, d)), -1.5, 1.5).withColumn("value", r6("value"))


@query("corr_distance", COUNTS + ", t AS (SELECT gene_id, grp, avg(value) AS v FROM dense JOIN cells USING (cell_id) GROUP BY 1, 2) SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round((1 - corr(a.v, b.v)) / 2, 6) AS distance FROM t a JOIN t b ON a.grp = b.grp AND a.gene_id < b.gene_id GROUP BY 1, 2")
def _(s, d):
    cds = counts(s, d)
    t = cds.dense().join(cds.cells.select("cell_id", "grp"), "cell_id").groupBy("gene_id", F.col("grp").alias("point_idx")).agg(F.avg("value").alias("value"))
    return plotdata.correlation_distance(t).select("gene_a", "gene_b", r6("distance").alias("distance"))


@query("state_crosstab", COUNTS + " SELECT grp, batch, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY batch), 6) AS share FROM cells GROUP BY 1, 2")
def _(s, d):
    return plotdata.crosstab(counts(s, d).cells, "grp", "batch").select("grp", "batch", "n", r6("share").alias("share"))


@query("gene_set_score", COUNTS + ", k AS (SELECT gene_id, gene_id < 'Brand#3' AS up FROM genes) SELECT cell_id, round(avg(value) FILTER (up) - avg(value) FILTER (NOT up), 6) AS score FROM dense JOIN k USING (gene_id) GROUP BY 1")
def _(s, d):
    cds = counts(s, d)
    return plotdata.gene_set_score(cds, cds.genes.where("gene_id < 'Brand#3'"), cds.genes.where("gene_id >= 'Brand#3'")).select("cell_id", r6("score").alias("score"))


@query("project_segment", "WITH q AS (SELECT s_suppkey AS cell_id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), t AS (SELECT *, ((x - 0) * 5000 + (y - 0) * 20) / (5000.0 * 5000 + 20 * 20) AS t FROM q) SELECT cell_id, round(5000 * greatest(0, least(1, t)), 6) AS px, round(20 * greatest(0, least(1, t)), 6) AS py FROM t")
def _(s, d):
    p = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    x, y = graph.project("x", "y", F.lit(0.0), F.lit(0.0), F.lit(5000.0), F.lit(20.0), clamp=True)
    return p.select("cell_id", r6(x).alias("px"), r6(y).alias("py"))


@query("disp_curve")
def _(s, d):
    fit = preprocess.estimate_dispersions(preprocess.estimate_size_factors(counts(s, d))).state("dispersion")["blind"]
    return s.createDataFrame([(fit["asymptDisp"], fit["extraPois"])], "asymptDisp double, extraPois double")


def timed(s, d):
    cds = sized(s, d)
    return cds.with_(cells=cds.cells.withColumn("Pseudotime", F.col("pt")))


@query("de_spline")
def _(s, d):
    return models.differential_gene_test(timed(s, d)).select("gene_id", "status", "family", "pval", "qval")


@query("smooth_curves")
def _(s, d):
    import numpy as np
    import pandas as pd

    cds = timed(s, d)
    low, high = cds.cells.agg(F.min("pt"), F.max("pt")).first()
    return models.smooth_curves(cds, pd.DataFrame({"Pseudotime": np.linspace(low, high, 20)}))


@query("beam")
def _(s, d):
    cds = timed(s, d)
    return models.beam(cds.with_(cells=cds.cells.withColumn("Branch", F.col("batch").cast("string")))).select("gene_id", "status", "pval", "qval")


@query("pca")
def _(s, d):
    return reduce.pca(normalize.normalize_expr(sized(s, d)), 5)[0]


# ---- the trajectory path. A learnt graph has no SQL form; the tests hold these against invariants and brute force.


def reduced(s, d):
    return trajectory.reduce_dimension(sized(s, d))


def ordered(s, d):
    return trajectory.order_cells(reduced(s, d))


@query("residual_covariates", COUNTS + LOGS + ", x AS (SELECT l.*, pt / 1000.0 AS t FROM l JOIN cells USING (cell_id)), b AS (SELECT gene_id, regr_slope(v, t) AS b FROM x GROUP BY 1) SELECT cell_id, gene_id, round(v - b * t, 6) AS value FROM x JOIN b USING (gene_id)")
def _(s, d):
    cds = sized(s, d)
    cells = cds.cells.withColumn("t", F.col("pt") / 1000)
    return trajectory.residuals(normalize.normalize_expr(cds), cells, "~t").withColumn("value", r6("value"))


@query("estimate_dc")
def _(s, d):
    return s.createDataFrame([(cluster.estimate_dc(from_embeddings(s, d)),)], "dc double")


@query("cluster_cells")
def _(s, d):
    points = from_embeddings(s, d)
    cds = counts(s, d).with_(cells=points.select("cell_id"), meta={"X_dr": points.select("cell_id", "coords")})
    got = trajectory.cluster_cells(cds, num_clusters=4)
    return got.cells.select("cell_id", "Cluster", "peaks", "halo", r6("rho").alias("rho"), r6("delta").alias("delta"))


@query("reduce_ddrtree")
def _(s, d):
    return reduced(s, d).state("X_dr")


@query("reduce_tsne")
def _(s, d):
    return trajectory.reduce_dimension(sized(s, d), reduction_method="tSNE").state("X_dr")


@query("mst")
def _(s, d):
    return reduced(s, d).state("graph").frames(sized(s, d).cells)[1]


@query("order_cells")
def _(s, d):
    return ordered(s, d).cells.select("cell_id", "Pseudotime", "State", "Parent")


def branched(s, d):
    """The dataset on a given principal graph, a Y: cells by group on its trunk and arms, pseudotime by their balance."""
    import numpy as np

    cds = sized(s, d)
    known = cds.cells.select("cell_id", "grp", "pt").orderBy("cell_id").toPandas()
    nodes = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 1.0], [3.0, -1.0]])
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.4), (2, 4, 1.4)]
    closest = known["grp"].map({0: 0, 1: 3, 2: 4}).to_numpy().copy()
    trunk = np.flatnonzero(closest == 0)
    closest[trunk[len(trunk) // 3 :]] = 1
    closest[trunk[2 * len(trunk) // 3 :]] = 2
    graph_ = trajectory.Graph(nodes, edges, known["cell_id"].tolist(), closest)
    state = F.col("grp") + 1
    pt = F.col("pt") - float(known["pt"].min()) + F.when(F.col("grp") > 0, 10_000).otherwise(0)
    cells = cds.cells.withColumn("State", state.cast("int")).withColumn("Pseudotime", pt.cast("double"))
    return cds.with_(cells=cells, meta=cds.meta | {"graph": graph_, "ordering": {"root_node": 0, "root_cell": known["cell_id"].tolist()[trunk[0]], "branch_points": [2]}})


SPLIT = COUNTS + ", z AS (SELECT cell_id, grp, pt - min(pt) OVER () + CASE WHEN grp > 0 THEN 10000 ELSE 0 END AS p FROM cells), s AS (SELECT max(p) FILTER (grp = 0) AS split, max(p) AS longest FROM z), e AS (SELECT grp, max(p) AS m FROM z GROUP BY 1), q AS (SELECT cell_id, grp, CASE WHEN grp = 0 THEN p ELSE split + (p - split) * (longest - split) / (m - split) END * 100 / longest AS p FROM z JOIN e USING (grp), s), a AS (SELECT cell_id, p, row_number() OVER (ORDER BY {by}) AS k FROM q WHERE grp = 0)"


@query("branch_dataset_split", SPLIT.format(by="p, cell_id") + " SELECT CAST(cell_id AS VARCHAR) AS cell_id, cell_id AS original_cell_id, CASE k % 2 WHEN 1 THEN 'Y_4' ELSE 'Y_5' END AS Branch, round(p, 6) AS Pseudotime FROM a UNION ALL SELECT 'duplicate_root', cell_id, 'Y_5', round(p, 6) FROM a WHERE k = 1 UNION ALL SELECT CAST(cell_id AS VARCHAR), cell_id, CASE grp WHEN 1 THEN 'Y_4' ELSE 'Y_5' END, round(p, 6) FROM q WHERE grp > 0")
def _(s, d):
    got = trajectory.build_branch_cell_dataset(branched(s, d))
    return got.cells.select("cell_id", "original_cell_id", "Branch", r6("Pseudotime").alias("Pseudotime"))


@query("branch_dataset_duplicate", SPLIT.format(by="cell_id") + ", b AS (SELECT 'duplicate_' || i || '_' || k AS name, cell_id AS o FROM a, (VALUES (1), (2)) v(i) UNION ALL SELECT CAST(cell_id AS VARCHAR), cell_id FROM q WHERE grp > 0) SELECT name AS cell_id, o AS original_cell_id, gene_id, value FROM b JOIN expr ON expr.cell_id = o")
def _(s, d):
    got = trajectory.build_branch_cell_dataset(branched(s, d), "duplicate", branch_states=[2, 3])
    return got.expr.join(got.cells.select("cell_id", "original_cell_id"), "cell_id").select("cell_id", "original_cell_id", "gene_id", "value")


@query("beam_branches")
def _(s, d):
    return trajectory.beam(branched(s, d)).select("gene_id", "status", "family", "pval", "qval")


@query("cal_ilrs")
def _(s, d):
    return trajectory.cal_ilrs(branched(s, d), n_points=20).select("gene_id", "point_idx", "ilr", "norm_ilr", "norm_div")


@query("cal_abcs")
def _(s, d):
    return trajectory.cal_abcs(branched(s, d), num=101).select("gene_id", "ABCs")


@query("plot_trajectory")
def _(s, d):
    return plots.trajectory_points(ordered(s, d), theta=90.0)


@query("plot_rho_delta", POINTS + f" SELECT cell_id, round(rho, 6) AS rho, round(delta, 6) AS delta, rho > {RHO} AND delta > {DELTA} AS peaks FROM near")
def _(s, d):
    return plots.rho_delta(peaked(s, d), RHO, DELTA).select("cell_id", r6("rho").alias("rho"), r6("delta").alias("delta"), "peaks")


@query("plot_clusters", POINTS + CLUSTERS + " SELECT cell_id, round(v[1], 6) AS x, round(v[2], 6) AS y, cluster AS color FROM p JOIN cl USING (cell_id)")
def _(s, d):
    points = peaked(s, d)
    named = cluster.assign_clusters(s, points, RHO, DELTA).select("cell_id", F.col("cluster").alias("color"))
    return plots.embedding_points(from_embeddings(s, d), named).select("cell_id", r6("x").alias("x"), r6("y").alias("y"), "color")


@query("plot_genes_pseudotime")
def _(s, d):
    cds = timed(s, d)
    few = cds.genes.orderBy("gene_id").limit(4).select("gene_id")
    return plots.genes_in_pseudotime(cds, few).select("cell_id", "gene_id", "feature_label", "Pseudotime", "expression", "expectation")


@query("plot_genes_branched")
def _(s, d):
    cds = branched(s, d)
    few = cds.genes.orderBy("gene_id").limit(3).select("gene_id")
    return plots.genes_branched(cds, few).select("cell_id", "gene_id", "Branch", "Pseudotime", "expression", "full_expectation", "reduced_expectation")


@query("plot_branches_lowess")
def _(s, d):
    cds = branched(s, d)
    few = cds.genes.orderBy("gene_id").limit(3).select("gene_id")
    return plots.branches_in_pseudotime(cds, few, [2, 3])


@query("plot_heatmap")
def _(s, d):
    return plots.pseudotime_heatmap(timed(s, d), num_clusters=4)


@query("plot_branched_heatmap")
def _(s, d):
    return plots.branched_heatmap(branched(s, d), num_clusters=4)


@query("plot_branches_heatmap")
def _(s, d):
    return plots.branches_heatmap(branched(s, d), [2, 3], num_clusters=4)


@query("plot_tree_layout")
def _(s, d):
    return plots.tree_layout(branched(s, d))


def _trapezoid(mid: float, top: float, foot: float) -> str:
    return f"round(greatest(0, least(1, ({foot / 2} - abs(i / 100 - {mid})) / {(foot - top) / 2})), 6)"


@query("color_ramp", "SELECT CAST(i AS INTEGER) AS i, " + ", ".join(f"{_trapezoid(*v)} AS {k}" for k, v in {"red": (0.8, 0.2, 1.0), "green": (0.5, 0.4, 0.8), "blue": (0.2, 0.2, 1.0)}.items()) + " FROM range(0, 101) t(i)")
def _(s, d):
    return plots.color_ramp(s, 101).select("i", r6("blue").alias("blue"), r6("green").alias("green"), r6("red").alias("red"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
