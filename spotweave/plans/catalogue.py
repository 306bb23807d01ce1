"""The registered queries of the molecule operators, with the SQL that each must equal.

Queries take the whole of their tables.  Fits that run to their own stops, triangulations, polygons, embeddings and
layouts have no SQL; tests/test_molecules.py and tests/test_embeddings.py hold their operators against brute force,
plain numpy or planted truth on small fixtures, but for the layouts, of which only invariants are tested."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..functions.shared import cut, shared_dir
from ..operators import aggregates as A
from ..operators import clusters, filters, graph, knn, ncv, noise, polygons, qc, ranges, raster, reports, segmentation
from ..options import DataOptions, SegmentationOptions
from ..sources import molecules as sources
from ..sources import sinks
from ..sources.views import L_SQL, M_SQL, counts, molecules, vectors

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
SCALE = 25.0


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _untied(df: DataFrame, *columns: str) -> DataFrame:
    """Means of two-decimal values moved off the ties of rounding, which the order of a sum would decide."""
    return df.withColumns({c: F.col(c) + 3e-9 for c in columns})


# Filters and encoders


@query(f"""WITH {M_SQL}, n AS (SELECT gene_name, count(*) AS c FROM M GROUP BY 1 HAVING count(*) >= 90), k AS (SELECT * FROM M WHERE gene_name IN (SELECT gene_name FROM n) AND NOT regexp_matches(gene_name, '^g9'))
SELECT molecule_id AS event, row_number() OVER (ORDER BY x, y, gene_name, molecule_id) AS molecule_id, dense_rank() OVER (ORDER BY gene_name)::INTEGER AS gene, gene_name FROM k""")
def gene_filter_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = filters.exclude_genes(filters.frequent_genes(molecules(spark, sf_dir), 90), "^g9")
    coded, _ = filters.encode_genes(m)
    named = coded.withColumnRenamed("molecule_id", "event")
    return filters.number_rows(named, ["x", "y", "gene_name", "event"]).select("event", "molecule_id", "gene", "gene_name")


@query(f"""WITH {M_SQL}, c AS (SELECT label, row_number() OVER (ORDER BY label) AS code FROM (SELECT DISTINCT prior_segmentation::VARCHAR AS label FROM M WHERE prior_segmentation <> 0)),
p AS (SELECT molecule_id, coalesce(code, 0) AS code FROM M LEFT JOIN c ON c.label = prior_segmentation::VARCHAR), n AS (SELECT code FROM p WHERE code > 0 GROUP BY code HAVING count(*) >= 65)
SELECT molecule_id, CASE WHEN code IN (SELECT code FROM n) THEN code ELSE 0 END AS prior_segmentation FROM p""")
def prior_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir).withColumn("label", F.col("prior_segmentation").cast("string"))
    return filters.small_segments(filters.parse_prior(m, "label"), 65).select("molecule_id", "prior_segmentation")


_MASK_SQL = """mask AS (SELECT DISTINCT round_even(y, 0)::BIGINT AS "row", round_even(x, 0)::BIGINT AS col FROM M), mask2 AS (SELECT "row", col, CASE WHEN ("row" + col) % 3 = 0 THEN 0 ELSE 1 + "row" // 50 * 10 + least(col // 50, 9) END AS label FROM mask)"""


def _mask(m: DataFrame) -> DataFrame:
    pixels = m.select(F.bround("y").cast("long").alias("row"), F.bround("x").cast("long").alias("col")).distinct()
    tile = 1 + F.floor(F.col("row") / 50) * 10 + F.least(F.floor(F.col("col") / 50), F.lit(9))
    return pixels.withColumn("label", F.when((F.col("row") + F.col("col")) % 3 == 0, 0).otherwise(tile).cast("long"))


@query(f"""WITH {M_SQL}, {_MASK_SQL} SELECT molecule_id, coalesce(label, 0)::BIGINT AS prior_segmentation FROM M LEFT JOIN mask2 ON "row" = round_even(y, 0)::BIGINT AND col = round_even(x, 0)::BIGINT""")
def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return raster.lookup(m, _mask(m)).select("molecule_id", "prior_segmentation")


@query(f"""WITH {M_SQL}, {_MASK_SQL}, r AS (SELECT sqrt(count(*) / pi()) AS r FROM mask2 WHERE label > 0 GROUP BY label), mid AS (SELECT quantile_cont(r, 0.5) AS scale FROM r)
SELECT round(scale, 6) AS scale, round(1.4826022185056018 * (SELECT quantile_cont(abs(r - scale), 0.5) FROM r, mid), 6) AS scale_std FROM mid""")
def scale_from_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.mask_scale(_mask(molecules(spark, sf_dir))), "scale", "scale_std")


@query(f"""WITH {M_SQL}, c AS (SELECT cell, avg(x) AS x, avg(y) AS y FROM M WHERE cell > 0 GROUP BY cell HAVING count(*) >= 3),
r AS (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / 2 AS r FROM c a JOIN c b ON a.cell <> b.cell GROUP BY a.cell), mid AS (SELECT quantile_cont(r, 0.5) AS scale FROM r)
SELECT round(scale, 6) AS scale, round(1.4826022185056018 * (SELECT quantile_cont(abs(r - scale), 0.5) FROM r, mid), 6) AS scale_std FROM mid""")
def scale_from_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.scale_from_assignment(molecules(spark, sf_dir), 3), "scale", "scale_std")


@query(f"""WITH {M_SQL}, r AS (SELECT molecule_id, row_number() OVER (ORDER BY x + y, molecule_id) AS k, count(*) OVER () AS hi FROM M WHERE confidence >= 0.25),
t AS (SELECT DISTINCT round_even(1 + i * ((hi - 1) / 499.0::DOUBLE), 0)::BIGINT AS k FROM (SELECT DISTINCT hi FROM r), unnest(generate_series(0, 499)) AS g(i))
SELECT molecule_id FROM r JOIN t USING (k)""")
def select_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.select_uniformly(molecules(spark, sf_dir), 500).select("molecule_id")


@query(f"""WITH {M_SQL}, n AS (SELECT cell, row_number() OVER (ORDER BY cell) AS c FROM (SELECT cell FROM M WHERE cell > 0 GROUP BY cell HAVING count(*) >= 40))
SELECT molecule_id, coalesce(c, 0)::INTEGER AS cell FROM M LEFT JOIN n USING (cell)""")
def drop_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_unused(molecules(spark, sf_dir).select("molecule_id", "cell"), 40)[0]


# Aggregations


@query(f"WITH {L_SQL} SELECT gene, cell, sum(w) AS n FROM L WHERE cell > 0 GROUP BY 1, 2")
def count_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_matrix(counts(spark, sf_dir), gene="gene", weight="w")


@query(f"""WITH {M_SQL} SELECT gene_name AS gene, count(*) FILTER (z = 0) AS "1", count(*) FILTER (z = 1) AS "2", count(*) FILTER (z = 2) AS "3" FROM M GROUP BY 1""")
def count_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wide_counts(A.count_matrix(molecules(spark, sf_dir).withColumn("cell", F.col("z") + 1)))


_SIG = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} / pow(10.0, floor(log10(abs({0}))) - 3), 0) * pow(10.0, floor(log10(abs({0}))) - 3) END"


@query(f"""WITH {M_SQL}, s AS (SELECT cell, avg(x) AS x, avg(y) AS y, count(*) AS n_transcripts, avg(confidence) AS ac, (var_pop(x) + var_pop(y)) / 2 AS h,
  sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2) AS g FROM M WHERE cell > 0 GROUP BY cell),
e AS (SELECT *, (h + g) / (h - g) AS el FROM s), k AS (SELECT cell, z + 1 AS c, count(*) AS n FROM M WHERE cell > 0 GROUP BY 1, 2),
b AS (SELECT cell, c AS cluster, n / sum(n) OVER (PARTITION BY cell) AS f, row_number() OVER (PARTITION BY cell ORDER BY n DESC, c) AS r FROM k)
SELECT cell, round(x + 3e-9, 6) AS x, round(y + 3e-9, 6) AS y, n_transcripts, CASE WHEN n_transcripts > 2 THEN round({_SIG.format('el')}, 8) END AS elongation,
  round({_SIG.format('ac')}, 8) AS avg_confidence, cluster, round(f, 6) AS max_cluster_frac FROM e JOIN b USING (cell) WHERE r = 1""")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = qc.cell_table(molecules(spark, sf_dir).withColumn("cluster", F.col("z") + 1), hulls=False)
    t = _rounded(_rounded(_untied(t, "x", "y"), "x", "y", "max_cluster_frac"), "elongation", "avg_confidence", digits=8)
    return t.withColumn("elongation", F.when(~F.isnan("elongation"), F.col("elongation"))).select("cell", "x", "y", "n_transcripts", "elongation", "avg_confidence", "cluster", "max_cluster_frac")


@query(f"""WITH {M_SQL}, p AS (SELECT DISTINCT prior_segmentation AS cell, x, y FROM M WHERE prior_segmentation > 0),
e AS (SELECT a.cell, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.cell = b.cell AND (a.x, a.y) <> (b.x, b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.cell = a.cell AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT cell, round(abs(sum(ax * by_ - bx * ay)) / 2, 4) AS area FROM e GROUP BY cell""")
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(qc.hull_areas(molecules(spark, sf_dir), "prior_segmentation"), "area", digits=4)


@query(f"WITH {M_SQL}, b AS (SELECT floor((x - 0) / 10)::BIGINT AS bin, count(*) AS n FROM M GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 8) AS fraction FROM b")
def histogram_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.histogram(molecules(spark, sf_dir), "x", 0.0, 10.0), "fraction", digits=8)


@query(f"WITH {M_SQL} SELECT round(avg(CASE WHEN confidence < 0.01 THEN 1.0 ELSE 0 END), 8) AS min_noise_frac, round(avg(1 - confidence), 8) AS expected_noise_frac FROM M")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.noise_summary(molecules(spark, sf_dir)), "min_noise_frac", "expected_noise_frac", digits=8)


@query(f"WITH {M_SQL} SELECT gene_name AS gene, count(*) FILTER (confidence >= 0.5) AS n_real, count(*) FILTER (confidence < 0.5) AS n_noise FROM M GROUP BY 1")
def expression_real_vs_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.real_and_noise(molecules(spark, sf_dir))


@query(f"""WITH {M_SQL}, n AS (SELECT cell, count(*) AS n FROM M WHERE cell > 0 GROUP BY 1)
SELECT t AS threshold, count(*) FILTER (n >= t) AS n_cells FROM n, unnest([1, 20, 40, 80, 200]) AS g(t) GROUP BY t""")
def size_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.size_trace(A.count_array(molecules(spark, sf_dir), "cell"), 40)


@query(f"""WITH {M_SQL}, n AS (SELECT cell, count(*) AS n FROM M WHERE cell > 0 GROUP BY 1) SELECT cell, round((n + 0.5) / (sum(n) OVER () + 0.5 * max(cell) OVER ()), 8) AS p FROM n""")
def smoothed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.smoothed_frequency(molecules(spark, sf_dir), "cell", 0.5), "p", digits=8)


@query(f"""WITH {M_SQL}, s AS (SELECT cell, sum(confidence) AS w, sum(confidence * x) AS wx, sum(confidence * x * x) AS wxx, sum(greatest(confidence, 0.01) * x) / sum(greatest(confidence, 0.01)) AS f FROM M WHERE cell > 0 GROUP BY 1)
SELECT cell, round(CASE WHEN w <> 0 THEN wx / w END, 5) AS mean, round(CASE WHEN w <> 0 THEN sqrt(greatest(wxx / w - (wx / w) ** 2, 0)) END, 5) AS sd, round(f, 5) AS floored FROM s""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = F.col("x"), F.col("confidence")
    per = molecules(spark, sf_dir).where("cell > 0").groupBy("cell").agg(A.weighted_mean(x, w).alias("mean"), A.weighted_sd(x, w).alias("sd"), A.floored_mean(x, w).alias("floored"))
    return _rounded(per, "mean", "sd", "floored", digits=5)


@query(f"""WITH {M_SQL}, mid AS (SELECT quantile_cont(x, 0.5) AS scale FROM M) SELECT round(scale, 6) AS scale, round(1.4826022185056018 * (SELECT quantile_cont(abs(x - scale), 0.5) FROM M, mid), 6) AS scale_std FROM mid""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.median_mad(molecules(spark, sf_dir), "x"), "scale", "scale_std")


@query(f"WITH {M_SQL} SELECT min(x) AS min_x, max(x) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM M")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.value_range(molecules(spark, sf_dir), ["x", "y"]), "min_y", "max_y")


@query(f"WITH {M_SQL} SELECT cell, count(DISTINCT gene_name) AS n_genes, count(gene_name)::DOUBLE AS sum_counts FROM M WHERE cell > 0 GROUP BY 1")
def expressed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expressed_genes(molecules(spark, sf_dir))


@query(f"WITH {M_SQL}, c AS (SELECT count(DISTINCT gene_name) AS n FROM M WHERE cell > 0 GROUP BY cell) SELECT round(avg(1.0::DOUBLE / n), 10) AS density FROM c")
def noise_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.noise_composition_density(A.expressed_genes(molecules(spark, sf_dir))), "density", digits=10)


@query(f"""WITH {M_SQL}, p AS (SELECT cell, prior_segmentation AS s, count(*) AS n FROM M WHERE cell > 0 GROUP BY 1, 2), z AS (SELECT prior_segmentation AS s, count(*) AS size FROM M GROUP BY 1),
r AS (SELECT cell, s AS main_segment, n AS n_main, row_number() OVER (PARTITION BY cell ORDER BY n DESC, size DESC, s) AS k FROM p JOIN z USING (s)) SELECT cell, main_segment, n_main FROM r WHERE k = 1""")
def main_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segments_of_cells(molecules(spark, sf_dir))[1]


_H_SQL = """H AS (SELECT iter, molecule_id, floor(('0x' || substr(md5('7:' || iter || ':' || molecule_id), 1, 8))::BIGINT / 4294967296.0 * 4)::BIGINT AS guid FROM M, unnest(generate_series(1, 5)) AS g(iter))"""


def _history(m: DataFrame) -> DataFrame:
    it = m.select("molecule_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("iter"))
    return it.select("iter", "molecule_id", F.floor(uniform(F.lit(7), F.col("iter"), F.col("molecule_id")) * 4).alias("guid"))


@query(f"""WITH {M_SQL}, {_H_SQL}, p AS (SELECT molecule_id, guid, count(*) AS n FROM H GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY n DESC, guid) AS k FROM p WHERE guid IN (0, 1, 3))
SELECT molecule_id, coalesce(r.guid, 0) AS guid, coalesce(r.n, 0) / 5.0::DOUBLE AS assignment_confidence FROM M LEFT JOIN r USING (molecule_id) WHERE coalesce(k, 1) = 1""")
def history_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    surviving = spark.createDataFrame([(1,), (3,)], "guid long")
    return segmentation.by_history(_history(m), surviving, m.select("molecule_id"))


@query(f"WITH {M_SQL}, {_H_SQL} SELECT guid, 5 - min(iter) + 1 AS lifespan FROM (SELECT iter, guid + molecule_id % 3 * iter AS guid FROM H) GROUP BY guid")
def lifespan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(molecules(spark, sf_dir)).select("iter", (F.col("guid") + F.col("molecule_id") % 3 * F.col("iter")).alias("guid"))
    return A.lifespan(h, 5)


# Joins in the plane


@query(f"""WITH {M_SQL}, c AS (SELECT cell, avg(x) AS cx, avg(y) AS cy FROM M WHERE cell > 0 GROUP BY 1),
d AS (SELECT molecule_id, c.cell AS centre, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS dist, row_number() OVER (PARTITION BY molecule_id ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2), c.cell) AS k FROM M, c)
SELECT molecule_id, centre::BIGINT AS centre, round(dist, 6) AS dist FROM d WHERE k = 1""")
def knn_to_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    centres = m.where("cell > 0").groupBy(F.col("cell").alias("molecule_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = knn.knn(centres, 1, m)
    return near.select(F.col("src").alias("molecule_id"), F.col("dst").alias("centre"), F.round("dist", 6).alias("dist"))


@query(f"""WITH {M_SQL}, b AS (SELECT cell, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM M WHERE cell > 0 GROUP BY 1) SELECT b.cell, molecule_id FROM M JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return ranges.points_in_boxes(m, ranges.bounding_boxes(m))


def _triangles(spark: SparkSession) -> DataFrame:
    t = F.col("id").cast("double")
    return spark.range(60).select(F.col("id").alias("triangle"), (t * 4).alias("ax"), (t % 7 * 10).alias("ay"), (t * 4 + 60).alias("bx"), (t % 5 * 30).alias("by"), (t * 3).alias("cx"), (t % 11 * 20 + 250).alias("cy"))


@query(f"""WITH {M_SQL}, t AS (SELECT i AS triangle, i * 4.0::DOUBLE AS ax, i % 7 * 10.0::DOUBLE AS ay, i * 4.0::DOUBLE + 60 AS bx, i % 5 * 30.0::DOUBLE AS by_, i * 3.0::DOUBLE AS cx, i % 11 * 20.0::DOUBLE + 250 AS cy FROM unnest(generate_series(0, 59)) AS g(i)),
d AS (SELECT triangle, (cx - ax) ** 2 + (cy - ay) ** 2 AS d00, (cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay) AS d01, (bx - ax) ** 2 + (by_ - ay) ** 2 AS d11, (cx - ax) * (x - ax) + (cy - ay) * (y - ay) AS d02, (bx - ax) * (x - ax) + (by_ - ay) * (y - ay) AS d12 FROM t, M),
u AS (SELECT triangle, (d11 * d02 - d01 * d12) / (d00 * d11 - d01 * d01) AS u, (d00 * d12 - d01 * d02) / (d00 * d11 - d01 * d01) AS v FROM d) SELECT triangle, count(*) FILTER (u >= 0 AND v >= 0 AND u + v < 1) AS n FROM u GROUP BY 1""")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.triangle_counts(molecules(spark, sf_dir), _triangles(spark))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + 0.1) AS e FROM embeddings), d AS (SELECT q.vec_id, p.label, list_distance(q.e, p.embedding::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, p.embedding::DOUBLE[]), p.vec_id) AS k FROM q, embeddings p)
SELECT vec_id, round(sum(label / (dist + 1e-10)) / sum(1 / (dist + 1e-10)), 6) AS label FROM d WHERE k <= 5 GROUP BY 1""")
def interpolate_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    dims = [f"d{i}" for i in range(64)]
    points = e.select("vec_id", "label", *(F.element_at("embedding", i + 1).cast("double").alias(d) for i, d in enumerate(dims)))
    moved = points.select("vec_id", *((F.col(d) + 0.1).alias(d) for d in dims))
    return _rounded(knn.interpolate(points, moved, ["label"], 5, tuple(dims), "vec_id"), "label")


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), q AS (SELECT quantile_cont(a, 0.0125) AS qa, quantile_cont(b, 0.0125) AS qb, quantile_cont(c, 0.0125) AS qc FROM e),
s AS (SELECT vec_id, greatest(a - qa, 0) AS a, greatest(b - qb, 0) AS b, greatest(c - qc, 0) AS c FROM e, q), t AS (SELECT quantile_cont(v, 0.9875) AS top FROM (SELECT a AS v FROM s UNION ALL SELECT b FROM s UNION ALL SELECT c FROM s))
SELECT vec_id, round(least(a / top, 1) * 80 + 10, 5) AS c1, round((least(b / top, 1) - 0.5) * 200, 5) AS c2, round((least(c / top, 1) - 0.5) * 200, 5) AS c3 FROM s, t""")
def lab_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("vec_id", *(F.element_at("embedding", i).cast("double").alias(f"c{i}") for i in (1, 2, 3)))
    return _rounded(ncv.lab_rescale(e), "c1", "c2", "c3", digits=5)


# Expectation and maximisation


def _chain(m: DataFrame) -> DataFrame:
    """Edges between molecules whose numbers differ by 1 to 3: a graph that SQL can make too."""
    steps = m.select(F.col("molecule_id").alias("src"), F.explode(F.array(*(F.lit(i) for i in (-3, -2, -1, 1, 2, 3)))).alias("d")).select("src", (F.col("src") + F.col("d")).alias("dst"), (1.0 / F.abs("d")).alias("weight"))
    return steps.join(m.select(F.col("molecule_id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


_CHAIN_SQL = "E AS (SELECT a.molecule_id AS src, b.molecule_id AS dst, 1.0::DOUBLE / abs(d) AS weight FROM M a, unnest([-3, -2, -1, 1, 2, 3]) AS g(d), M b WHERE b.molecule_id = a.molecule_id + d)"
_SETTINGS = segmentation.Settings(SCALE, SCALE / 4, 10, stochastic=False)


def _shrink(v: str) -> str:
    d = f"(sqrt(greatest({v}, 0)) - 25)"
    return f"pow((10 * 25 + n * (25 + sign({d}) * (sqrt(abs({d}) / 6.25 + 1) - 1) * 6.25)) / (10 + n), 2)"


_FIT_SQL = f"""s AS (SELECT cell, count(*) AS n, avg(x) AS mu_x, avg(y) AS mu_y, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c0, count(DISTINCT gene_name) AS n_genes, count(*)::DOUBLE AS sum_counts FROM M WHERE cell > 0 GROUP BY cell),
s2 AS (SELECT *, CASE WHEN c0 / greatest(greatest(a, b), 1e-300) < 1e-5 THEN 0 ELSE c0 END AS c FROM s), s3 AS (SELECT *, (a + b) / 2 AS h, sqrt(((a - b) / 2) ** 2 + c * c) AS g FROM s2),
s4 AS (SELECT *, {_shrink('(h + g)')} AS p, {_shrink('(h - g)')} AS q FROM s3),
C AS (SELECT cell, n, mu_x, mu_y, n_genes, sum_counts, CASE WHEN n > 2 THEN (p + q) / 2 + CASE WHEN g > 0 THEN (p - q) / (2 * g) * (a - b) / 2 ELSE 0 END ELSE 625 END AS s_00,
  CASE WHEN n > 2 AND g > 0 THEN (p - q) / (2 * g) * c ELSE 0 END AS s_10, CASE WHEN n > 2 THEN (p + q) / 2 - CASE WHEN g > 0 THEN (p - q) / (2 * g) * (a - b) / 2 ELSE 0 END ELSE 625 END AS s_11 FROM s4)"""


@query(f"""WITH {M_SQL}, {_FIT_SQL} SELECT cell, n, round(mu_x + 3e-9, 7) AS mu_x, round(mu_y + 3e-9, 7) AS mu_y, round(s_00, 4) AS s_00, round(s_10, 4) AS s_10, round(s_11, 4) AS s_11, n_genes, round(0.5 * ln(pow(2 * pi(), 3) * (s_00 * s_11 - s_10 * s_10)), 6) AS log_norm FROM C""")
def mstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    cells = segmentation.fit_cells(m.drop("cell"), m.select("molecule_id", "cell"), _SETTINGS)
    cells = _rounded(_rounded(_rounded(_untied(cells, "mu_x", "mu_y"), "mu_x", "mu_y", digits=7), "s_00", "s_10", "s_11", digits=4), "log_norm")
    return cells.select("cell", "n", "mu_x", "mu_y", "s_00", "s_10", "s_11", "n_genes", "log_norm")


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, {_FIT_SQL}, K AS (SELECT cell, gene_name, count(*)::DOUBLE AS cnt FROM M WHERE cell > 0 GROUP BY 1, 2), nd AS (SELECT 1 / (2 * pi()) / 625 * exp(-9) * avg(1.0::DOUBLE / n_genes) AS nd FROM C),
W AS (SELECT src AS molecule_id, M.cell, sum(weight) AS w FROM E JOIN M ON M.molecule_id = dst GROUP BY 1, 2),
D AS (SELECT W.molecule_id, W.cell, M.confidence * exp(0.1 * w) * n * exp(-0.5 * (s_11 * (x - mu_x) ** 2 - 2 * s_10 * (x - mu_x) * (y - mu_y) + s_00 * (y - mu_y) ** 2) / (s_00 * s_11 - s_10 * s_10)
    - 0.5 * ln(pow(2 * pi(), 3) * (s_00 * s_11 - s_10 * s_10))) * greatest(coalesce(cnt, 0), 1) / (sum_counts + 1) AS dens
  FROM W JOIN M USING (molecule_id) JOIN C ON C.cell = W.cell LEFT JOIN K ON K.cell = W.cell AND K.gene_name = M.gene_name WHERE W.cell > 0),
Z AS (SELECT * FROM D UNION ALL SELECT molecule_id, 0, (1 - confidence) * nd FROM M, nd WHERE confidence < 1), T AS (SELECT *, sum(dens) OVER (PARTITION BY molecule_id) AS total, row_number() OVER (PARTITION BY molecule_id ORDER BY dens DESC, CASE WHEN cell = 0 THEN 2147483647 ELSE cell END) AS r FROM Z)
SELECT molecule_id, CASE WHEN total < 1e-100 THEN 0 ELSE cell END::INTEGER AS cell FROM T WHERE r = 1""")
def estep_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    assigned, mols = m.select("molecule_id", "cell"), m.drop("cell", "prior_segmentation", "z")
    cells = cut(segmentation.fit_cells(mols, assigned, _SETTINGS), "cells")
    return segmentation.expectation(mols, _chain(m), assigned, cells, _SETTINGS)


def _unit(j: int) -> str:
    return f"floor(('0x' || substr(md5(gene_name || ':{j}'), 1, 8))::BIGINT / 4294967296.0 * 10000) / 1e5"


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, n AS (SELECT gene_name, count(*) AS n FROM M GROUP BY 1), X AS (SELECT gene_name, {', '.join(f'(n * (0.95 + {_unit(j)}) + 1) / (sum(n) OVER () + 1) AS e{j}' for j in (1, 2, 3))} FROM n),
P AS (SELECT molecule_id, gene_name, confidence, {', '.join(f'e{j} / (e1 + e2 + e3) AS p{j}' for j in (1, 2, 3))} FROM M JOIN X USING (gene_name)),
S AS (SELECT src AS molecule_id, {', '.join(f'sum(weight * b.confidence * p{j}) AS s{j}' for j in (1, 2, 3))} FROM E JOIN P b ON b.molecule_id = dst GROUP BY 1),
R AS (SELECT molecule_id, gene_name, confidence, {', '.join(f'e{j} * exp(coalesce(s{j}, 0)) AS r{j}' for j in (1, 2, 3))} FROM P LEFT JOIN S USING (molecule_id) JOIN X USING (gene_name)),
Q AS (SELECT gene_name, {', '.join(f'sum(confidence * r{j} / (r1 + r2 + r3)) AS q{j}' for j in (1, 2, 3))} FROM R GROUP BY 1)
SELECT gene_name, {', '.join(f'round((q{j} + 1) / (sum(q{j}) OVER () + 1), 8) AS e{j}' for j in (1, 2, 3))} FROM Q""")
def cluster_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    x = cut(clusters.hashed_expression(m, 3), "expression")
    total = F.col("e1") + F.col("e2") + F.col("e3")
    state = m.select("molecule_id", "gene_name", "confidence").join(x, "gene_name").select("molecule_id", "gene_name", "confidence", *((F.col(f"e{j}") / total).alias(f"p{j}") for j in (1, 2, 3)))
    conf = m.select(F.col("molecule_id").alias("dst"), F.col("confidence").alias("_c"))
    edges = _chain(m).join(conf, "dst").select("src", "dst", (F.col("weight") * F.col("_c")).alias("weight"))
    return _rounded(clusters.cluster_expression(clusters.cluster_step(state, edges, x, 3), 3), "e1", "e2", "e3", digits=8)


# Small operators on views that SQL can make too


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = molecules(spark, sf_dir)
    return m, cut(graph.edge_lengths(_chain(m), m), "lengths")  # quantiles read them some times over


_LENGTH_SQL = "G AS (SELECT src, dst, weight, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS length FROM E JOIN M a ON a.molecule_id = src JOIN M b ON b.molecule_id = dst)"


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, {_LENGTH_SQL}, l AS (SELECT *, CASE WHEN length > 0 THEN log10(length) END AS l FROM G), mid AS (SELECT quantile_cont(l, 0.5) AS m FROM l),
t AS (SELECT m + 2 * 1.4826022185056018 * (SELECT quantile_cont(abs(l - m), 0.5) FROM l, mid) AS top FROM mid) SELECT src, dst FROM l, t WHERE coalesce(l < top, true)""")
def long_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.long_edges(_values(spark, sf_dir)[1]).select("src", "dst")


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, {_LENGTH_SQL}, q AS (SELECT quantile_cont(length, 0.3) AS q FROM G), h AS (SELECT src, dst, length, q / greatest(length, q) AS weight FROM G, q WHERE src < dst),
s AS (SELECT * FROM h UNION ALL SELECT dst, src, length, weight FROM h) SELECT src, dst, round(length, 7) AS length, round(weight, 8) AS weight FROM s""")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _values(spark, sf_dir)[1]
    weighted = graph.edge_weights(lengths)
    return _rounded(_rounded(graph.symmetric(weighted.where("src < dst")), "length", digits=7), "weight", digits=8)


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, v AS (SELECT molecule_id, x / 100 AS a, y / 100 AS b, confidence AS c, (x / 100 + y / 100 + confidence) / 3 AS m FROM M),
p AS (SELECT src, dst, weight, (p.a - p.m) * (q.a - q.m) + (p.b - p.m) * (q.b - q.m) + (p.c - p.m) * (q.c - q.m) AS pq, (p.a - p.m) ** 2 + (p.b - p.m) ** 2 + (p.c - p.m) ** 2 AS pp, (q.a - q.m) ** 2 + (q.b - q.m) ** 2 + (q.c - q.m) ** 2 AS qq
  FROM E JOIN v p ON p.molecule_id = src JOIN v q ON q.molecule_id = dst)
SELECT src, dst, round(weight * greatest(CASE WHEN pp * qq > 0 THEN pq / sqrt(pp * qq) ELSE 0 END, 0.01), 6) AS weight FROM p""")
def similarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    v = m.select("molecule_id", F.array(F.col("x") / 100, F.col("y") / 100, "confidence").alias("vector"))
    return _rounded(graph.similarity_weights(_chain(m), v).select("src", "dst", "weight"), "weight")


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, d AS (SELECT src, dst, weight * (1 - (1 - b.confidence) * a.confidence) AS weight FROM E JOIN M a ON a.molecule_id = src JOIN M b ON b.molecule_id = dst)
SELECT src, dst, round(weight, 8) AS weight FROM d WHERE weight > 0.5""")
def damp_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    probs = m.select("molecule_id", F.col("confidence").alias("nucleus"), (1 - F.col("confidence")).alias("cyto"))
    return _rounded(graph.damp_compartments(_chain(m), probs, True, 0.5).select("src", "dst", "weight"), "weight", digits=8)


@query(f"""WITH {M_SQL}, d AS (SELECT molecule_id, greatest(abs(x / 100 - y / 100), abs(0.5 - confidence)) * confidence AS c FROM M) SELECT round(max(c), 8) AS max_change, round(avg(CASE WHEN c > 1e-7 THEN 1.0 ELSE 0 END), 8) AS share_changed FROM d""")
def largest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    state = lambda a, b: m.select("molecule_id", F.explode(F.array(F.struct(F.lit(1).alias("j"), a.alias("p")), F.struct(F.lit(2).alias("j"), b.alias("p")))).alias("s")).select("molecule_id", "s.*")
    before, after = state(F.col("x") / 100, F.lit(0.5)), state(F.col("y") / 100, F.col("confidence"))
    return _rounded(A.largest_change(before, after, ["molecule_id", "j"], "p", m, "molecule_id"), "max_change", "share_changed", digits=8)


@query(f"WITH {M_SQL} SELECT cell, string_agg(molecule_id::VARCHAR, ',' ORDER BY molecule_id) AS ids FROM M WHERE cell > 0 GROUP BY 1")
def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_ids(molecules(spark, sf_dir), "cell").select("cell", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {M_SQL}, s AS (SELECT cell, gene_name, sum(confidence) AS v FROM M WHERE gene_name IS NOT NULL GROUP BY 1, 2 HAVING sum(confidence) > 0.3) SELECT cell, gene_name, round(v / sum(v) OVER (PARTITION BY cell), 8) AS v FROM s")
def sparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.sparse_counts(molecules(spark, sf_dir), "cell", "gene_name", F.col("confidence"), True, 0.3), "v", digits=8)


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, {_H_SQL} SELECT src, dst, round(avg(CASE WHEN a.guid = b.guid AND a.guid > 0 THEN 1.0 ELSE 0 END), 8) AS share FROM E JOIN H a ON a.molecule_id = src JOIN H b ON b.molecule_id = dst AND b.iter = a.iter GROUP BY 1, 2""")
def co_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return _rounded(segmentation.co_assignment(_history(m), _chain(m)), "share", digits=8)


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, s AS (SELECT * FROM M WHERE confidence >= 0.5), p AS (SELECT a.gene_name AS g1, b.gene_name AS g2, sum(weight) AS w FROM E JOIN s a ON a.molecule_id = src JOIN s b ON b.molecule_id = dst GROUP BY 1, 2),
o AS (SELECT g1 AS g, sum(w) AS w FROM p GROUP BY 1) SELECT g1, g2, round(p.w / greatest(sqrt(a.w * b.w), 0.1), 8) AS v FROM p JOIN o a ON a.g = g1 JOIN o b ON b.g = g2""")
def cooccurrence_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return _rounded(A.cooccurrence(_chain(m), m, 0.5), "v", digits=8)


@query(f"WITH {M_SQL} SELECT molecule_id, CASE WHEN cell > 0 THEN 'CR7-' || cell ELSE '' END AS cell, cell = 0 AS is_noise, round_even(confidence, 5) AS confidence, round_even(confidence / 3, 5) AS assignment_confidence FROM M")
def molecule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir).withColumn("assignment_confidence", F.col("confidence") / 3)
    return qc.molecule_table(m, "R7").select("molecule_id", "cell", "is_noise", "confidence", "assignment_confidence")


@query(f"""WITH {M_SQL}, {_H_SQL}, o AS (SELECT molecule_id, x, y, confidence, prior_segmentation AS cell FROM M WHERE prior_segmentation > 0), p AS (SELECT DISTINCT cell, x, y FROM o), s AS (SELECT cell, count(*) AS n, avg(confidence) AS c FROM o GROUP BY 1),
e AS (SELECT a.cell, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.cell = b.cell AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.cell = a.cell AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
hl AS (SELECT cell, abs(sum(ax * by_ - bx * ay)) / 2 AS raw FROM e GROUP BY cell), r AS (SELECT cell, {_SIG.format('raw')} AS area FROM hl), l AS (SELECT cell, 5 - min(iter) + 1 AS lifespan FROM H JOIN o USING (molecule_id) WHERE guid = 3 GROUP BY 1)
SELECT cell, CASE WHEN n > 2 THEN round(area, 6) END AS area, CASE WHEN n > 2 AND area > 0 THEN round({_SIG.format('(n / area)')}, 8) END AS density, round({_SIG.format('(c / 3)')}, 8) AS avg_assignment_confidence, coalesce(lifespan, -1) AS lifespan
FROM s LEFT JOIN r USING (cell) LEFT JOIN l USING (cell)""")
def cell_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir).withColumn("cell", F.col("prior_segmentation")).withColumn("assignment_confidence", F.col("confidence") / 3)
    seen = _history(m).where("guid = 3").join(m.select("molecule_id", "cell"), "molecule_id").select(F.col("cell").alias("guid"), "iter")
    t = qc.cell_table(m, lifespans=A.lifespan(seen, 5).withColumnRenamed("guid", "cell"))
    t = t.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("area", "density")})
    return _rounded(_rounded(t, "area"), "density", "avg_assignment_confidence", digits=8).select("cell", "area", "density", "avg_assignment_confidence", "lifespan")


@query(f"""WITH {M_SQL}, k AS (SELECT 'assigned' AS kind, confidence FROM M WHERE cell > 0 UNION ALL SELECT 'noise', confidence FROM M WHERE cell = 0), b AS (SELECT kind, floor(confidence / 0.025)::BIGINT AS bin, count(*) AS n FROM k GROUP BY 1, 2)
SELECT kind, bin, n, round(n / sum(n) OVER (PARTITION BY kind), 8) AS fraction FROM b""")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    odd = m.withColumn("cell", F.when(F.col("molecule_id") % 7 == 0, 0).otherwise(F.col("cell")))
    return _rounded(reports.confidence_bins(odd), "fraction", digits=8)


_SQL["confidence_bins"] = _SQL["confidence_bins"].replace("WHERE cell > 0", "WHERE molecule_id % 7 <> 0 AND cell > 0").replace("WHERE cell = 0", "WHERE molecule_id % 7 = 0 OR cell = 0")


@query(f"""WITH {M_SQL}, n AS (SELECT cell, count(*) AS n FROM M WHERE cell > 0 GROUP BY 1), t AS (SELECT quantile_cont(n, 0.99) / 0.99 AS top FROM n), s AS (SELECT floor(n / greatest(top / 30, 1.0))::BIGINT AS bin FROM n, t WHERE n > 1 AND n < top), b AS (SELECT bin, count(*) AS n FROM s GROUP BY 1)
SELECT bin, n, round(n / sum(n) OVER (), 8) AS fraction FROM b""")
def cells_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = A.count_array(molecules(spark, sf_dir), "cell").withColumnRenamed("n", "n_transcripts")
    return _rounded(reports.cells_by_size(per), "fraction", digits=8)


@query(f"""WITH {M_SQL}, a AS (SELECT count(*) AS n, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM M), s AS (SELECT 15 * sqrt(n / 30.0::DOUBLE) AS side, sqrt(dy / dx) AS ratio FROM a), p AS (SELECT side / sqrt(ratio) AS w, side * ratio AS h, least(1.0, 3000 / greatest(side / sqrt(ratio), side * ratio, 1)) AS k FROM s)
SELECT greatest(1, round_even(w * k, 0))::BIGINT AS width, greatest(1, round_even(h * k, 0))::BIGINT AS height FROM p""")
def panel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([reports.panel_size(molecules(spark, sf_dir), 30)], "width long, height long")


# Sources and sinks: what is written, read back


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


_LOADED_SQL = f"""WITH {M_SQL}, n AS (SELECT gene_name FROM M GROUP BY 1 HAVING count(*) >= 80), k AS (SELECT * FROM M WHERE gene_name IN (SELECT gene_name FROM n) AND NOT regexp_matches(gene_name, '^g1'))
SELECT row_number() OVER (ORDER BY x, y, z, gene_name) AS molecule_id, round(x, 6) AS x, round(y, 6) AS y, z::DOUBLE AS z, dense_rank() OVER (ORDER BY gene_name)::INTEGER AS gene, gene_name FROM k"""


def _loaded(spark: SparkSession, path: str) -> DataFrame:
    options = DataOptions(x="px", y="py", gene="name", min_molecules_per_gene=80, exclude_genes="^g1")
    got, _ = sources.load_molecules(spark, path, options)
    return got.select("molecule_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z", "gene", "gene_name")


def _renamed_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules(spark, sf_dir).select(F.col("x").alias("px"), F.col("y").alias("py"), "z", F.col("gene_name").alias("name"))


@query(_LOADED_SQL)
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "molecules.csv")
    sinks.save_csv(_renamed_molecules(spark, sf_dir), path)
    return _loaded(spark, path)


@query(_LOADED_SQL)
def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "molecules.PARQUET")
    _renamed_molecules(spark, sf_dir).write.parquet(path)
    return _loaded(spark, path)


@query(f"WITH {L_SQL} SELECT gene, cell, sum(w)::DOUBLE AS n FROM L WHERE cell > 0 GROUP BY 1, 2")
def counts_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "counts.tsv")
    sinks.save_counts_tsv(A.count_matrix(counts(spark, sf_dir), gene="gene", weight="w"), path)
    return sinks.read_counts_tsv(spark, path)


@query(f"""WITH {M_SQL}, {_MASK_SQL}, f AS (SELECT * FROM mask2 WHERE label <> 0) SELECT molecule_id, coalesce(label, 0)::BIGINT AS prior_segmentation FROM M LEFT JOIN f ON "row" = round_even(y, 0)::BIGINT AND col = round_even(x, 0)::BIGINT""")
def mask_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, path = molecules(spark, sf_dir), _fresh(spark, "mask.csv")
    sinks.save_csv(_mask(m), path)
    return raster.lookup(m, sources.read_mask(spark, path)).select("molecule_id", "prior_segmentation")


@query(f"""WITH {M_SQL}, c AS (SELECT label, row_number() OVER (ORDER BY label) AS code FROM (SELECT DISTINCT prior_segmentation::VARCHAR AS label FROM M WHERE prior_segmentation <> 0)),
p AS (SELECT molecule_id, coalesce(code, 0) AS code FROM M LEFT JOIN c ON label = prior_segmentation::VARCHAR), n AS (SELECT code FROM p WHERE code > 0 GROUP BY 1 HAVING count(*) >= 60) SELECT molecule_id, CASE WHEN code IN (SELECT code FROM n) THEN code ELSE 0 END AS prior_segmentation FROM p""")
def prior_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir).withColumn("label", F.col("prior_segmentation").cast("string")).drop("prior_segmentation")
    return sources.prior_from_column(m, ":label", "0", 60).select("molecule_id", "prior_segmentation")


@query(f"""WITH {M_SQL}, k AS (SELECT molecule_id, prior_segmentation % 3 AS a FROM M), r AS (SELECT a, count(*) AS n FROM k GROUP BY 1) SELECT (sum(n) - count(*))::BIGINT AS repeats FROM r""")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = molecules(spark, sf_dir).select((F.col("prior_segmentation") % 3).alias("a"))
    return spark.createDataFrame([(sources.repeated_rows(few),)], "repeats long")


@query(f"""WITH {M_SQL}, r AS (SELECT count(*) AS n, avg(x) AS x, bool_and(z = 1) AS flat FROM M WHERE z = 1) SELECT n, round(x + 3e-9, 7) AS x, NOT flat AS has_z FROM r""")
def flat_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = sources.normalise(molecules(spark, sf_dir).where("z = 1").withColumnRenamed("gene_name", "gene"))
    has = "z" in flat.columns
    return _rounded(_untied(flat.agg(F.count("*").alias("n"), F.avg("x").alias("x")), "x"), "x", digits=7).withColumn("has_z", F.lit(has))


@query(f"""WITH {M_SQL}, {_CHAIN_SQL}, q AS (SELECT quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM M), b AS (SELECT lo, hi, (hi - lo) / 4 AS sd, hi + 3 * (hi - lo) / 4 AS border FROM q),
z0 AS (SELECT molecule_id, x AS d, x > border AS o, (exp(-0.5 * ((x - lo) / sd) * ((x - lo) / sd)) / (sqrt(2 * pi()) * sd)) AS a, CASE WHEN x > border THEN 1.0 ELSE (exp(-0.5 * ((x - hi) / sd) * ((x - hi) / sd)) / (sqrt(2 * pi()) * sd)) END AS b FROM M, b), z AS (SELECT molecule_id, d, o, a / greatest(a + b, 1e-20) AS p FROM z0),
f AS (SELECT sum(p) AS n1, sum(p * d) / sum(p) AS m1, greatest(sqrt(greatest(sum(p * d * d) / sum(p) - (sum(p * d) / sum(p)) ** 2, 0)), 1e-10) AS s1, sum(1 - p) AS n2, sum((1 - p) * d) / sum(1 - p) AS m2, greatest(sqrt(greatest(sum((1 - p) * d * d) / sum(1 - p) - (sum((1 - p) * d) / sum(1 - p)) ** 2, 0)), 1e-10) AS s2 FROM z WHERE NOT o), nn AS (SELECT src AS molecule_id, sum(weight * p) AS w1, sum(weight * (1 - p)) AS w2 FROM E JOIN z ON z.molecule_id = dst GROUP BY 1),
y0 AS (SELECT z.molecule_id, d, o, n1 * exp(coalesce(w1, 0)) * (exp(-0.5 * ((d - m1) / s1) * ((d - m1) / s1)) / (sqrt(2 * pi()) * s1)) AS d1, n2 * exp(coalesce(w2, 0)) * (exp(-0.5 * ((d - m2) / s2) * ((d - m2) / s2)) / (sqrt(2 * pi()) * s2)) AS d2 FROM z LEFT JOIN nn USING (molecule_id), f),
y AS (SELECT molecule_id, d, o, CASE WHEN o THEN 0 ELSE d1 / greatest(d1 + d2, 1e-20) END AS p FROM y0), g AS (SELECT sum(p) AS n1, sum(p * d) / sum(p) AS m1, greatest(sqrt(greatest(sum(p * d * d) / sum(p) - (sum(p * d) / sum(p)) ** 2, 0)), 1e-10) AS s1, sum(1 - p) AS n2, sum((1 - p) * d) / sum(1 - p) AS m2, greatest(sqrt(greatest(sum((1 - p) * d * d) / sum(1 - p) - (sum((1 - p) * d) / sum(1 - p)) ** 2, 0)), 1e-10) AS s2 FROM y WHERE NOT o),
h AS (SELECT n1, n2, least(m1, m2) AS m1, greatest(m1, m2) AS m2, CASE WHEN m1 > m2 THEN s2 ELSE s1 END AS s1, CASE WHEN m1 > m2 THEN s1 ELSE s2 END AS s2 FROM g),
r AS (SELECT molecule_id, CASE WHEN o THEN 0 ELSE n1 * (exp(-0.5 * ((d - m1) / s1) * ((d - m1) / s1)) / (sqrt(2 * pi()) * s1)) / greatest(n1 * (exp(-0.5 * ((d - m1) / s1) * ((d - m1) / s1)) / (sqrt(2 * pi()) * s1)) + n2 * (exp(-0.5 * ((d - m2) / s2) * ((d - m2) / s2)) / (sqrt(2 * pi()) * s2)), 1e-20) END AS c FROM y, h)
SELECT molecule_id, round(c, 7) AS confidence, CASE WHEN 1 - c > 0.5 THEN 2 ELSE 1 END AS assignment FROM r""")
def noise_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise fit's start and one round of it, on distances and a graph that SQL has too."""
    m = molecules(spark, sf_dir)
    found, _ = noise.fit_noise(m.select("molecule_id", F.col("x").alias("d")), _chain(m), most=1)
    return _rounded(found.select("molecule_id", "confidence", "assignment"), "confidence", digits=7)


# Graphs of nearest neighbours and all that stands on them


def _near_sql(points: str, k: int) -> str:
    """N: src, dst, dist of the k nearest points, by all pairs."""
    return f"""N AS (SELECT src, n.id AS dst, n.d AS dist FROM (SELECT a.molecule_id AS src, unnest(min({{'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'id': b.molecule_id}}, {k})) AS n FROM {points} a, {points} b GROUP BY 1))"""


_UNIT = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_POINTS_SQL = f"""b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS most FROM M), s AS (SELECT molecule_id, (x - x0) / (most * 1.1) + 1.01 AS x, (y - y0) / (most * 1.1) + 1.01 AS y FROM M, b),
w AS (SELECT *, count(*) OVER (PARTITION BY round_even(x, 6), round_even(y, 6)) > 1 AS same FROM s),
P AS (SELECT molecule_id, x + CASE WHEN same THEN ({_UNIT.format("molecule_id || ':0:x'")} - 0.5) * 2e-5 ELSE 0 END AS x, y + CASE WHEN same THEN ({_UNIT.format("molecule_id || ':0:y'")} - 0.5) * 2e-5 ELSE 0 END AS y FROM w)"""
_EDGES_SQL = f"""{_POINTS_SQL}, {_near_sql('P', 5)}, u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM N WHERE src <> dst),
l AS (SELECT src, dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS length FROM u JOIN P p ON p.molecule_id = src JOIN P q ON q.molecule_id = dst)"""


def _weights_sql(lengths: str) -> str:
    return f"""qq AS (SELECT quantile_cont(length, 0.3) AS q FROM {lengths}), h AS (SELECT src, dst, length, q / greatest(length, q) AS weight FROM {lengths}, qq), E AS (SELECT * FROM h UNION ALL SELECT dst, src, length, weight FROM h)"""


_KNN_GRAPH_SQL = f"""{_EDGES_SQL}, g AS (SELECT *, CASE WHEN length > 0 THEN log10(length) END AS lg FROM l), mid AS (SELECT quantile_cont(lg, 0.5) AS m FROM g),
top AS (SELECT m + 2 * 1.4826022185056018 * (SELECT quantile_cont(abs(lg - m), 0.5) FROM g, mid) AS top FROM mid), short AS (SELECT src, dst, length FROM g, top WHERE coalesce(lg < top, true)), {_weights_sql('short')}"""


@query(f"WITH {M_SQL}, {_near_sql('M', 6)} SELECT src, dst, round(dist, 9) AS dist, row_number() OVER (PARTITION BY src ORDER BY N.dist, dst)::INTEGER AS rank FROM N")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.knn(molecules(spark, sf_dir), 6), "dist", digits=9)


def _graph(m: DataFrame, adjacency: str = "knn", keep_long: bool = False) -> DataFrame:
    return cut(graph.neighbour_graph(m, adjacency=adjacency, keep_long=keep_long).select("src", "dst", "length", "weight"), "graph")


@query(f"WITH {M_SQL}, {_KNN_GRAPH_SQL} SELECT src, dst, round(length, 10) AS length, round(weight, 8) AS weight FROM E")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(_graph(molecules(spark, sf_dir)), "length", digits=10), "weight", digits=8)


@query()
def delaunay_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(molecules(spark, sf_dir), "triangulation")


@query(f"""WITH {M_SQL}, {_EDGES_SQL}, {_weights_sql('l')}, s2 AS (SELECT * FROM M WHERE confidence >= 0.95), p2 AS (SELECT a.gene_name AS g1, b.gene_name AS g2, sum(weight) AS w FROM E JOIN s2 a ON a.molecule_id = src JOIN s2 b ON b.molecule_id = dst GROUP BY 1, 2),
o AS (SELECT g1 AS g, sum(w) AS w FROM p2 GROUP BY 1) SELECT g1, g2, round(p2.w / greatest(sqrt(a.w * b.w), 0.1), 7) AS v FROM p2 JOIN o a ON a.g = g1 JOIN o b ON b.g = g2""")
def gene_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return _rounded(A.cooccurrence(_graph(m, keep_long=True), m), "v", digits=7)


def _ncv(m: DataFrame) -> DataFrame:
    return cut(ncv.composition_vectors(m, 10), "ncv")


_NCV_SQL = f"""{_near_sql('M', 10)}, f AS (SELECT src, min(dist) AS d FROM N WHERE dist > 1e-15 GROUP BY 1), mm AS (SELECT quantile_cont(d, 0.5) AS m FROM f),
c AS (SELECT src AS molecule_id, gene_name AS gene, sum(1 / greatest(dist, m)) AS v FROM N JOIN M ON molecule_id = dst, mm WHERE gene_name IS NOT NULL GROUP BY 1, 2 HAVING sum(1 / greatest(dist, m)) > 1e-5),
NCV AS (SELECT molecule_id, gene, v / sum(v) OVER (PARTITION BY molecule_id) AS v FROM c)"""
_COEXP_SQL = "X AS (SELECT a.gene AS g1, b.gene AS g2, sum(a.v * b.v) AS v FROM NCV a JOIN NCV b USING (molecule_id) GROUP BY 1, 2)"


@query(f"WITH {M_SQL}, {_NCV_SQL} SELECT molecule_id, gene, round(v, 8) AS v FROM NCV")
def composition_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ncv(molecules(spark, sf_dir)), "v", digits=8)


@query(f"WITH {M_SQL}, {_NCV_SQL} SELECT molecule_id, gene, round(ln(v * 10000 + 1e-5), 6) AS v FROM NCV")
def log_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ncv.log_values(_ncv(molecules(spark, sf_dir))), "v")


@query(f"WITH {M_SQL}, {_NCV_SQL}, {_COEXP_SQL} SELECT g1, g2, round(v, 7) AS v FROM X")
def coexpression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ncv.coexpression(_ncv(molecules(spark, sf_dir))), "v", digits=7)


_GENES_SQL = f"""t AS (SELECT g1, sum(v) AS total, sum(CASE WHEN g1 = g2 THEN v ELSE 0 END) AS own FROM X GROUP BY 1), lim AS (SELECT quantile_cont(own / total, 0.95) AS lim FROM t),
y AS (SELECT g1, g2, CASE WHEN g1 = g2 THEN least(v, lim * total) ELSE v END AS v FROM X JOIN t USING (g1), lim), al AS (SELECT g1, sum(v) AS a FROM y GROUP BY 1),
rn AS (SELECT g2, i AS component, sqrt(-2 * ln(greatest({_UNIT.format("'42:' || g2 || ':' || i || ':a'")}, pow(2.0, -33)))) * cos(2 * pi() * {_UNIT.format("'42:' || g2 || ':' || i || ':b'")}) AS r FROM (SELECT DISTINCT g2 FROM y), unnest(generate_series(1, 20)) AS gs(i)),
GV AS (SELECT g1 AS gene, component, sum(v * r) / any_value(a) AS e FROM y JOIN rn USING (g2) JOIN al USING (g1) GROUP BY 1, 2)"""


@query(f"WITH {M_SQL}, {_NCV_SQL}, {_COEXP_SQL}, {_GENES_SQL} SELECT gene, component::INTEGER AS component, round(e, 6) AS e FROM GV")
def gene_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ncv.gene_vectors(ncv.coexpression(_ncv(molecules(spark, sf_dir))), 20), "e")


@query(f"WITH {M_SQL}, {_NCV_SQL}, {_COEXP_SQL}, {_GENES_SQL} SELECT molecule_id, (component - 1)::INTEGER AS component, round(sum(v * e), 6) AS e FROM NCV JOIN GV USING (gene) GROUP BY 1, 2")
def molecule_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _ncv(molecules(spark, sf_dir))
    made = ncv.molecule_vectors(v, cut(ncv.gene_vectors(ncv.coexpression(v), 20), "genes"))
    return _rounded(made.select("molecule_id", F.posexplode("vector").alias("component", "e")), "e")


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ncv.pca(vectors(spark, sf_dir), 5, "vec_id", "embedding")


@query()
def gaussian_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.gaussian_clusters(vectors(spark, sf_dir), 10)


@query()
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ncv.colours(vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")), key="vec_id")


@query()
def gene_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return ncv.gene_structure(A.cooccurrence(_graph(m, keep_long=True), m), m)


@query()
def label_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.label_polygons(_mask(molecules(spark, sf_dir)))


@query()
def noise_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir).drop("confidence")
    return noise.append_confidence(m, 5).select("molecule_id", "confidence")


@query()
def molecule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return clusters.cluster_molecules(m, _graph(m, "auto", keep_long=True), 4)[0]


@query()
def molecule_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return clusters.compartments(m, _graph(m, "auto", keep_long=True), ["g0", "g1", "g2"], ["g3", "g4", "g5"], SCALE)


@query(f"""WITH RECURSIVE {M_SQL}, {_KNN_GRAPH_SQL}, inside AS (SELECT src, dst FROM E JOIN M a ON a.molecule_id = src JOIN M b ON b.molecule_id = dst WHERE a.cell = b.cell AND a.cell > 0),
reach AS (SELECT molecule_id AS a, molecule_id AS b FROM M WHERE cell > 0 UNION SELECT a, dst FROM reach JOIN inside ON src = b),
part AS (SELECT a, min(b) AS label, count(*) AS n FROM reach GROUP BY 1), best AS (SELECT cell, label, row_number() OVER (PARTITION BY cell ORDER BY n DESC, label) AS r FROM part JOIN M ON molecule_id = a)
SELECT M.molecule_id, CASE WHEN best.cell IS NOT NULL THEN M.cell ELSE 0 END::INTEGER AS cell FROM M LEFT JOIN part ON a = M.molecule_id LEFT JOIN best ON best.cell = M.cell AND best.label = part.label AND r = 1""")
def components_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molecules(spark, sf_dir)
    return graph.split_cells(m.select("molecule_id", "cell"), _graph(m))


@query()
def segment_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop, with prior segmentation and clusters: the default iterations, a tenth of them as history."""
    m = molecules(spark, sf_dir).withColumn("cluster", F.col("z") + 1).drop("cell", "z")
    iters = SegmentationOptions().iters
    s = segmentation.Settings(SCALE, SCALE / 4, 30, history_depth=round(0.1 * iters))
    start = segmentation.initial_cells(m, max(2, m.count() // 30 * 2), s)
    return segmentation.segment(m, _graph(m, "auto"), start, iters, s)["assigned"]


@query()
def boundary_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.boundary_polygons(molecules(spark, sf_dir))


@query()
def polygons_by_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.polygons_by_z(molecules(spark, sf_dir))


@query()
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.geojson(polygons.boundary_polygons(molecules(spark, sf_dir)))
