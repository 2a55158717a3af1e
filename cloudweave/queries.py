"""A query for each operator over the given tables, and SQL that gives the same rows.

Views: series are ``embeddings`` (64 values, 10 classes) or ``events`` of a user in six-hour buckets; bars
are ``lineitem`` rows (an order's line is a bar, its status the direction); module probabilities are slices of an
embedding; accuracy rows are shares of finished orders by nation, priority and year.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.operators import barcodes, baselines, clouds, density, embedding, evaluate, features, independence, pairs, reports
from cloudweave.plans import class_features, experiments
from cloudweave.sources import series as sources
from cloudweave.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TAU, M, STRIDE = 4, 10, 3
#: Class clouds that SQL can still follow: a tenth of the points, 20 to 60.
FEW = clouds.Sizes(fraction=0.1, least=20, most=60, small=30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; a local master does with one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cloudweave-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_vectors(table(spark, sf_dir, "embeddings"))


SERIES = "series AS (SELECT vec_id AS series_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
POINTS = SERIES + ", points AS (SELECT label, series_id, CAST(i AS INTEGER) AS point_idx, list_transform(generate_series(0, 9), lambda j: v[i * 3 + j * 4 + 1]) AS coords FROM series, generate_series(0, 9) g(i))"


# --- Sources ---


@query("""
SELECT user_id AS series_id, CAST(user_id % 3 AS INTEGER) AS label, CAST(b AS INTEGER) AS bucket, round(coalesce(m, 0.0), 6) + 0.0 AS value
FROM (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31') u CROSS JOIN generate_series(0, 119) g(b)
LEFT JOIN (SELECT user_id AS k, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 21600) AS INTEGER) AS bucket, avg(value) AS m FROM events GROUP BY 1, 2) e ON e.k = u.user_id AND e.bucket = b
""")
def s2_series_from_events(spark, sf_dir):
    wide = event_series(spark, sf_dir)
    return wide.select("series_id", "label", F.posexplode("values").alias("bucket", "value")).withColumn("value", r6("value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.bucketed(table(spark, sf_dir, "events"), "user_id", "ts", "value", "2024-01-01", 21600, 120)
    return rows.select("series_id", (F.col("series_id") % 3).cast("int").alias("label"), "values")


@query(f"WITH {SERIES} SELECT series_id, label, CAST(i - 1 AS INTEGER) AS at, round(v[i], 6) + 0.0 AS value FROM series, generate_series(1, 64) g(i)")
def s2_series_from_vectors(spark, sf_dir):
    rows = vector_series(spark, sf_dir).select("series_id", "label", F.posexplode("values").alias("at", "value"))
    return rows.withColumn("value", r6("value"))


@query(f"WITH {SERIES} SELECT label, CAST(len(v) AS INTEGER) AS length, count(*) AS n, round(sum(list_sum(v)), 4) + 0.0 AS total FROM series GROUP BY 1, 2")
def s1_series_from_text(spark, sf_dir):
    """The vectors written as whitespace text, a series a line, and read back."""
    path = f"{work_dir(spark)}/text"
    line = F.concat_ws("  ", F.col("label").cast("double").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), " "))
    vector_series(spark, sf_dir).select(line).write.text(path)
    got = sources.read_text(spark, path)
    total = F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    return got.groupBy("label", F.size("values").alias("length")).agg(F.count("*").alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


@query(f"WITH {SERIES} SELECT label, count(*) AS n, count(*) AS ids, round(sum(list_sum(v)), 4) + 0.0 AS total FROM (SELECT label, v FROM series UNION ALL SELECT label, v FROM series WHERE label % 2 = 0) GROUP BY 1")
def s1_repeated_lines(spark, sf_dir):
    """Text with every line of the even labels twice: each line is a series of its own."""
    path = f"{work_dir(spark)}/text"
    line = F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), " "))
    s = vector_series(spark, sf_dir)
    s.unionByName(s.where("label % 2 = 0")).select(line).coalesce(1).write.text(path)
    total = F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x))
    got = sources.read_text(spark, path)
    return got.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("ids"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


@query(f"""WITH {SERIES} SELECT count(*) AS series, count(*) FILTER (v IS NULL OR len(v) = 0) AS empty,
count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (label IS NULL) AS unlabelled,
CAST(min(len(v)) AS BIGINT) AS shortest, CAST(max(len(v)) AS BIGINT) AS longest FROM series""")
def s3_validate(spark, sf_dir):
    return sources.problems(vector_series(spark, sf_dir))


@query("""
SELECT p.series_id, p.module, p.class_label, round(p.p * w.weight, 6) + 0.0 AS weighted FROM
(SELECT o_orderkey AS series_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS module, CAST(o_orderkey % 3 AS INTEGER) AS class_label, o_totalprice / 1e6 AS p, o_orderpriority AS combo, year(o_orderdate) AS seed, o_orderstatus AS dataset FROM orders) p
JOIN (SELECT o_orderstatus AS dataset, year(o_orderdate) AS seed, o_orderpriority AS combo, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS module, avg(o_totalprice) / 1e6 AS weight FROM orders GROUP BY 1, 2, 3, 4) w USING (dataset, seed, combo, module)
""")
def s7_weight_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series_id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("module"), (F.col("o_orderkey") % 3).cast("int").alias("class_label"), (F.col("o_totalprice") / 1e6).alias("p"), F.col("o_orderpriority").alias("combo"), F.year("o_orderdate").alias("seed"), F.col("o_orderstatus").alias("dataset"))
    weights = o.groupBy("dataset", "seed", "combo", "module").agg(F.avg("p").alias("weight"))
    return sinks.apply_weights(o, weights).select("series_id", "module", "class_label", r6(F.col("p") * F.col("weight")).alias("weighted"))


@query(f"""WITH {SERIES} SELECT min(series_id) AS series_id, count(DISTINCT v) AS n FROM series
WHERE v NOT IN (SELECT v FROM series WHERE series_id % 3 = 0) GROUP BY v""")
def s8_missing_keys(spark, sf_dir):
    """What the store lacks when it has a third of all series: equal values have one key."""
    rows = vector_series(spark, sf_dir).select("series_id", F.array(F.col("values")).alias("points")).withColumn("key", sinks.content_key("points"))
    new = sinks.missing(rows, rows.where("series_id % 3 = 0"))
    return rows.join(new.select("key"), "key", "left_semi").groupBy("key").agg(F.min("series_id").alias("series_id"), F.lit(1).cast("long").alias("n")).select("series_id", "n")


@query()
def s8_barcode_store(spark, sf_dir):
    """Bars of all pairs with the class's default cloud, when a third of them is in the store already."""
    rows = small_clouds(spark, sf_dir).withColumn("key", sinks.content_key("points", "class_points"))
    path = f"{work_dir(spark)}/store"
    compute = lambda p: barcodes.cross_barcodes(p, ["key"])
    sinks.with_store(rows.where("series_id % 3 = 0"), path, compute)
    return sinks.with_store(rows, path, compute).select("key", F.size("bars").alias("n_bars"))


# --- Transforms ---


@query(f"WITH {POINTS} SELECT series_id, point_idx, CAST(j - 1 AS INTEGER) AS coord_idx, round(coords[j], 6) + 0.0 AS value FROM points, generate_series(1, 10) h(j)")
def p1_delay_embedding(spark, sf_dir):
    rows = clouds.points(embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE))
    return rows.select("series_id", "point_idx", F.posexplode("coords").alias("coord_idx", "value")).withColumn("value", r6("value"))


@query("""
WITH lengths AS (SELECT DISTINCT CAST(n AS INTEGER) AS length FROM (SELECT count(*) AS n FROM events GROUP BY user_id)),
grid AS (SELECT length, t, d, s, (d - 1) * t + 1 AS span FROM lengths, generate_series(1, 8) a(t), generate_series(1, 12) b(d), generate_series(1, 4) c(s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY CASE WHEN floor((length - span) / s) >= 5 THEN 0 ELSE 1 END, s DESC, d DESC, t DESC) AS r FROM grid WHERE span <= length)
SELECT length, CAST(t AS INTEGER) AS tau, CAST(d AS INTEGER) AS m, CAST(s AS INTEGER) AS stride FROM ranked WHERE r = 1
""")
def p2_embedding_cap(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("length"))
    return embedding.cap_grid(lengths, 8, 12, 4)


@query("""SELECT user_id, n, CAST(CASE WHEN n <= 0 THEN 0 WHEN n < 60 THEN n ELSE least(greatest(round_even(n * 0.5, 0), 20), 45) END AS INTEGER) AS budget
FROM (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY user_id)""")
def p6_cloud_budget(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return counts.withColumn("budget", embedding.cloud_budget(F.col("n"), 0.5, 20, 45, 60))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 WHEN x = 'Infinity'::DOUBLE THEN 1e6 WHEN x = '-Infinity'::DOUBLE THEN -1e6 ELSE round(x, 6) END + 0.0 AS value FROM
(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 3 THEN '-Infinity'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS x FROM lineitem)""")
def p7_clean_values(spark, sf_dir):
    n = F.col("l_linenumber")
    x = F.when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).when(n == 4, None).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(embedding.clean(x)).alias("value"))


def accuracy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset (nation), method (priority), seed (year), source, holdout_accuracy, dataset_type (region)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("dataset"), F.col("r_name").alias("dataset_type"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("seed")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("holdout_accuracy"))


ACC = """acc AS (SELECT n_name AS dataset, r_name AS dataset_type, o_orderpriority AS method, year(o_orderdate) AS seed, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS holdout_accuracy
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""


@query("""SELECT s_suppkey, coalesce(r_name, 'UNKNOWN') AS dataset_type, coalesce(r_name, 'UNKNOWN') IN ('ASIA', 'EUROPE') AS is_dynamical
FROM supplier LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) ON s_nationkey = n_nationkey""")
def p8_dynamical_flag(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dimension = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("dataset"), F.col("r_name").alias("dataset_type"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dataset"))
    return embedding.dynamical(rows, dimension, ("ASIA", "EUROPE")).select("s_suppkey", "dataset_type", "is_dynamical")


# --- Sampling ---


@query(f"""WITH {POINTS} SELECT label, series_id, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7:', series_id, ':', point_idx)), series_id, point_idx) AS r FROM points) WHERE r <= 40""")
def t1_uniform_subsample(spark, sf_dir):
    return clouds.uniform_sample(vector_pool(spark, sf_dir), ("label",), 40, 7, "series_id", "point_idx").select("label", "series_id", "point_idx")


def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.pooled(embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE))


@query(f"""WITH {POINTS} SELECT series_id, count(*) AS n_points, round(sum(coords[1]), 6) + 0.0 AS first_sum FROM
(SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY md5(concat('3:', series_id, ':', point_idx))) AS r FROM points) WHERE r <= 6 GROUP BY series_id""")
def t3_series_clouds(spark, sf_dir):
    sizes = clouds.Sizes(fraction=0.6, least=2, most=6, small=8)
    got = clouds.series_clouds(embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE), sizes, 3)
    first = F.aggregate("points", F.lit(0.0), lambda a, p: a + F.get(p, F.lit(0)))
    return got.select("series_id", F.size("points").cast("long").alias("n_points"), r6(first).alias("first_sum"))


@query(f"WITH {POINTS} SELECT label, series_id, point_idx, round(list_sum(coords), 6) + 0.0 AS total FROM points")
def t4_pooled_class_cloud(spark, sf_dir):
    total = F.aggregate("coords", F.lit(0.0), lambda a, x: a + x)
    return vector_pool(spark, sf_dir).select("label", "series_id", "point_idx", r6(total).alias("total"))


SIZES = """sizes AS (SELECT label, CAST(n AS INTEGER) AS n, series, CAST(largest AS INTEGER) AS largest, CAST(greatest(CASE WHEN n - largest >= 20 THEN least(s, n - largest) ELSE s END, 1) AS INTEGER) AS size FROM
(SELECT *, CASE WHEN n <= 0 THEN 0 WHEN n < 30 THEN n ELSE least(greatest(round_even(n * 0.1, 0), 20), 60) END AS s FROM
(SELECT label, sum(k) AS n, count(*) AS series, max(k) AS largest FROM (SELECT label, series_id, count(*) AS k FROM points GROUP BY 1, 2) GROUP BY 1)))"""


@query(f"WITH {POINTS}, {SIZES} SELECT label, n, series, largest, size FROM sizes")
def t5_class_sizes(spark, sf_dir):
    return clouds.class_sizes(vector_pool(spark, sf_dir), FEW).select("label", "n", "series", "largest", "size")


@query(f"""WITH {POINTS}, {SIZES}, excluded AS (SELECT DISTINCT label, series_id AS exclude_series FROM points UNION ALL SELECT DISTINCT label, NULL FROM points),
ranked AS (SELECT p.label, e.exclude_series, p.series_id, p.point_idx, row_number() OVER (PARTITION BY p.label, e.exclude_series ORDER BY md5(concat('0:', p.label, ':', p.series_id, ':', p.point_idx)), p.series_id, p.point_idx) AS r
FROM points p JOIN excluded e ON p.label = e.label AND p.series_id IS DISTINCT FROM e.exclude_series)
SELECT ranked.label, coalesce(exclude_series, -1) AS exclude_series, series_id, point_idx FROM ranked JOIN sizes USING (label) WHERE r <= size""")
def t6_leave_one_out_subclouds(spark, sf_dir):
    pool = vector_pool(spark, sf_dir)
    got = clouds.subclouds(pool, clouds.class_sizes(pool, FEW))
    return got.select("label", F.coalesce("exclude_series", F.lit(-1)).alias("exclude_series"), "series_id", "point_idx")


@query(f"""WITH {POINTS}, chosen AS (SELECT label, series_id FROM (SELECT label, series_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat('5:', label, ':', series_id)), series_id) AS r FROM (SELECT DISTINCT label, series_id FROM points)) WHERE r <= 30)
SELECT label, series_id, point_idx FROM (SELECT p.*, row_number() OVER (PARTITION BY p.label, p.series_id ORDER BY md5(concat('5:', p.series_id, ':', point_idx)), p.series_id, point_idx) AS r FROM points p JOIN chosen USING (label, series_id)) WHERE r = 1""")
def t7_one_point_per_series(spark, sf_dir):
    return clouds.one_per_series(vector_pool(spark, sf_dir), 30, 5).select("label", "series_id", "point_idx")


@query(f"""WITH {POINTS}, d AS (SELECT a.label, a.series_id, a.point_idx, sum(sqrt(list_sum(list_transform(generate_series(1, 10), lambda i: (a.coords[i] - b.coords[i]) * (a.coords[i] - b.coords[i]))))) AS apart FROM points a JOIN points b USING (label, series_id) GROUP BY 1, 2, 3)
SELECT label, series_id, point_idx, round(apart, 5) + 0.0 AS apart FROM (SELECT *, row_number() OVER (PARTITION BY label, series_id ORDER BY round(apart, 9) DESC, point_idx) AS r FROM d) WHERE r = 1""")
def t7_farthest_point_per_series(spark, sf_dir):
    pool = vector_pool(spark, sf_dir)
    got = clouds.one_per_series(pool, 1 << 30, 5, "maxmin")
    other = pool.select("label", "series_id", F.col("coords").alias("other"))
    apart = F.sqrt(F.aggregate(F.zip_with("coords", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    return got.join(other, ["label", "series_id"]).groupBy("label", "series_id", "point_idx").agg((F.round(F.sum(apart), 5) + F.lit(0.0)).alias("apart"))


@query(f"""WITH {POINTS}, {SIZES}, c AS (SELECT label, count(*) AS points, count(DISTINCT series_id) AS series FROM points GROUP BY 1)
SELECT c.label, points, c.series, size AS target, largest, least(size, points) AS actual, c.series <= 1 AS empty_without_one, least(least(size, points), 10) < 15 AS small FROM c JOIN sizes USING (label)""")
def t8_cloud_size_report(spark, sf_dir):
    pool = vector_pool(spark, sf_dir)
    return clouds.size_report(pool, clouds.class_sizes(pool, FEW), 10)


# --- Pairs ---


@query(f"WITH {SERIES} SELECT series_id, s.label, c.label AS class_label, CASE WHEN s.label = c.label THEN series_id ELSE -1 END AS exclude_series FROM series s CROSS JOIN (SELECT DISTINCT label FROM series) c")
def j1_class_pairs(spark, sf_dir):
    s = vector_series(spark, sf_dir).select("series_id", "label")
    classes = [r[0] for r in s.select("label").distinct().orderBy("label").collect()]
    return pairs.class_pairs(s, classes).withColumn("exclude_series", F.coalesce("exclude_series", F.lit(-1).cast("long")))


@query(f"WITH {SERIES} SELECT series_id, label, CAST(r AS INTEGER) AS repeat FROM series, generate_series(1, 3) g(r)")
def j2_repeat_draws(spark, sf_dir):
    s = vector_series(spark, sf_dir).select("series_id", "label")
    classes = [r[0] for r in s.select("label").distinct().orderBy("label").collect()]
    return pairs.repeat_draws(pairs.class_pairs(s, classes), 4).select("series_id", "label", "repeat")


@query(f"""WITH {SERIES} SELECT series_id, CAST(i AS INTEGER) AS slot, round(x, 6) + 0.0 AS value FROM (SELECT series_id, unnest([0, 1, 2]) AS i, unnest([list_sum(v), list_max(v), v[64] - v[1]]) AS x FROM series)""")
def j3_combined_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    s = vector_series(spark, sf_dir)
    stats = baselines.descriptive(s).select("series_id", "sum_values", "maximum")
    both = features.combine([stats, baselines.signature(s).select("series_id", "s_x")], ["series_id"])
    return both.select("series_id", F.posexplode(vector_to_array("features")).alias("slot", "value")).withColumn("value", r6("value"))


@query("""SELECT dataset, n_train, n_test, classes, n_train * classes * 2 + n_train * 3 AS fit_barcodes, n_test * classes * 2 AS transform_barcodes, (n_train * classes * 2 + n_train * 3 + n_test * classes * 2) * 25 * 6 AS all_barcodes FROM
(SELECT 'vectors' AS dataset, count(*) FILTER (vec_id % 5 <> 0) AS n_train, count(*) FILTER (vec_id % 5 = 0) AS n_test, count(DISTINCT label) AS classes FROM embeddings
UNION ALL SELECT 'users', count(DISTINCT user_id) FILTER (user_id % 5 <> 0), count(DISTINCT user_id) FILTER (user_id % 5 = 0), count(DISTINCT user_id % 3) FROM events)""")
def j4_barcode_budget(spark, sf_dir):
    vectors = vector_series(spark, sf_dir).select(F.lit("vectors").alias("dataset"), "label", sources.is_test(F.col("series_id")).alias("is_test"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().select(F.lit("users").alias("dataset"), (F.col("user_id") % 3).cast("int").alias("label"), sources.is_test(F.col("user_id")).alias("is_test"))
    return pairs.barcode_budget(vectors.unionByName(users), 4, seeds=25)


# --- Bars ---

BARS = """bars AS (SELECT l_orderkey AS pair, CASE WHEN l_linestatus = 'O' THEN 'qc' ELSE 'cq' END AS direction, CAST(l_linenumber % 2 AS INTEGER) AS hom_dim, l_discount AS birth,
CASE WHEN l_partkey % 50 = 0 THEN 'Infinity'::DOUBLE ELSE l_discount + l_quantity / 50 END AS death, l_returnflag AS class_label FROM lineitem),
slots AS (SELECT pair, direction, CAST(hom_dim AS INTEGER) AS hom_dim FROM (SELECT DISTINCT pair FROM bars), (VALUES ('qc'), ('cq')) d(direction), (VALUES (0), (1)) h(hom_dim)),
longest AS (SELECT pair, direction, hom_dim, max(death - birth) FILTER (NOT isinf(death)) AS top FROM bars GROUP BY ALL),
lives AS (SELECT b.pair, b.direction, b.hom_dim, birth, death, class_label, least(greatest(CASE WHEN isinf(death) THEN coalesce(top, 0.0) ELSE death - birth END, 0.0), 1e6) AS life FROM bars b JOIN longest USING (pair, direction, hom_dim)),
thresholds AS (SELECT hom_dim, quantile_cont(life, 0.25) AS t0, quantile_cont(life, 0.5) AS t1, quantile_cont(life, 0.75) AS t2 FROM lives GROUP BY hom_dim)"""


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    endless = F.col("l_partkey") % 50 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair"), F.when(F.col("l_linestatus") == "O", "qc").otherwise("cq").alias("direction"), (F.col("l_linenumber") % 2).cast("int").alias("hom_dim"),
        F.col("l_discount").alias("birth"), F.when(endless, float("inf")).otherwise(F.col("l_discount") + F.col("l_quantity") / 50).alias("death"), F.col("l_returnflag").alias("class_label"),
    )


def line_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = line_bars(spark, sf_dir)
    return barcodes.gather_bars(bars, bars.drop("class_label"), ["pair"], (0, 1))


def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    slotted = line_slots(spark, sf_dir)
    return barcodes.scalars(slotted, barcodes.betti_thresholds(slotted))


@query(f"WITH {BARS} SELECT pair, direction, hom_dim, count(*) AS n, round(sum(life), 6) + 0.0 AS total, round(max(life), 6) + 0.0 AS longest FROM lives GROUP BY ALL")
def x3_lifetimes(spark, sf_dir):
    rows = line_slots(spark, sf_dir).withColumn("life", barcodes.lifetimes()).where(F.size("life") > 0)
    total = F.aggregate("life", F.lit(0.0), lambda a, x: a + x)
    return rows.select("pair", "direction", "hom_dim", F.size("life").cast("long").alias("n"), r6(total).alias("total"), r6(F.array_max("life")).alias("longest"))


@query(f"WITH {BARS} SELECT hom_dim, round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1, round(t2, 6) + 0.0 AS t2 FROM thresholds")
def x4_betti_thresholds(spark, sf_dir):
    got = barcodes.betti_thresholds(line_slots(spark, sf_dir))
    return got.select("hom_dim", *(r6(F.get("thresholds", F.lit(k))).alias(f"t{k}") for k in range(3)))


def _rep(name: str, sql: str):
    def f(spark, sf_dir):
        return line_scalars(spark, sf_dir).select("pair", "direction", "hom_dim", r6(name).alias(name))

    number = {"mtd": 5, "total_persistence": 6, "pers_entropy": 7, "landscape_l2": 8}[name]
    f.__name__ = f"x{number}_{name}"
    query(f"WITH {BARS} SELECT s.pair, s.direction, s.hom_dim, round(coalesce({sql}, 0.0), 6) + 0.0 AS {name} FROM slots s LEFT JOIN lives l ON s.pair = l.pair AND s.direction = l.direction AND s.hom_dim = l.hom_dim GROUP BY ALL")(f)


_rep("mtd", "CASE WHEN isinf(sum(death - birth)) THEN 1e6 WHEN sum(death - birth) > 1e6 THEN 1e6 ELSE sum(death - birth) END")
_rep("total_persistence", "CASE WHEN isinf(sum((death - birth) * (death - birth))) THEN 1e6 WHEN sum((death - birth) * (death - birth)) > 1e6 THEN 1e6 ELSE sum((death - birth) * (death - birth)) END")
_rep("pers_entropy", "CASE WHEN sum(life) > 0 THEN log2(sum(life)) - sum(life * log2(life)) FILTER (life > 0) / sum(life) ELSE 0.0 END")
_rep("landscape_l2", "sqrt(sum(life * life))")


@query(f"""WITH {BARS} SELECT s.pair, s.direction, s.hom_dim, CAST(count(*) FILTER (life >= t0 - 1e-12) AS DOUBLE) AS betti_0, CAST(count(*) FILTER (life >= t1 - 1e-12) AS DOUBLE) AS betti_1, CAST(count(*) FILTER (life >= t2 - 1e-12) AS DOUBLE) AS betti_2
FROM slots s JOIN thresholds t ON s.hom_dim = t.hom_dim LEFT JOIN lives l ON s.pair = l.pair AND s.direction = l.direction AND s.hom_dim = l.hom_dim GROUP BY ALL""")
def x9_betti(spark, sf_dir):
    slotted = line_slots(spark, sf_dir)
    # The engines' interpolations may differ in the last bit, which must not decide a count.
    t = barcodes.betti_thresholds(slotted).withColumn("thresholds", F.transform("thresholds", lambda x: x - 1e-12))
    return barcodes.scalars(slotted, t).select("pair", "direction", "hom_dim", "betti_0", "betti_1", "betti_2")


# --- Blocks and densities ---

MTD = BARS + """, mtds AS (SELECT s.pair, s.direction, s.hom_dim, coalesce(sum(life), 0.0) AS value FROM slots s LEFT JOIN lives l ON s.pair = l.pair AND s.direction = l.direction AND s.hom_dim = l.hom_dim GROUP BY ALL),
sides AS (SELECT pair, hom_dim, max(value) FILTER (direction = 'qc') AS qc, max(value) FILTER (direction = 'cq') AS cq FROM mtds GROUP BY ALL),
classed AS (SELECT s.*, f.class_label FROM sides s JOIN (SELECT pair, min(class_label) AS class_label FROM bars GROUP BY 1) f USING (pair))"""


def line_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, hom_dim, qc, cq, asym, class_label) of summed lifetimes."""
    total = F.aggregate(barcodes.lifetimes(), F.lit(0.0), lambda a, x: a + x)
    scores = line_slots(spark, sf_dir).select("pair", "direction", "hom_dim", F.round(total, 9).alias("value"))
    classes = line_bars(spark, sf_dir).groupBy("pair").agg(F.min("class_label").alias("class_label"))
    return features.sides(scores, ["pair", "hom_dim"]).join(classes, "pair")


@query(f"WITH {MTD} SELECT pair, hom_dim, round(qc, 6) + 0.0 AS qc, round(cq, 6) + 0.0 AS cq FROM sides")
def f1_raw_scores(spark, sf_dir):
    return line_sides(spark, sf_dir).select("pair", "hom_dim", r6("qc").alias("qc"), r6("cq").alias("cq"))


@query(f"WITH {MTD} SELECT pair, hom_dim, round(qc - cq, 6) + 0.0 AS asym FROM sides")
def f2_asymmetry(spark, sf_dir):
    return line_sides(spark, sf_dir).select("pair", "hom_dim", r6("asym").alias("asym"))


@query(f"""WITH {MTD} SELECT class_label, hom_dim, count(*) AS n, count(DISTINCT round(qc, 9)) AS distinct_values, round(min(qc), 6) + 0.0 AS least, round(max(qc), 6) + 0.0 AS most,
round(sqrt(2 * sum(qc * qc) / (2 * count(*) - 1)) * pow(2 * count(*), -0.2), 6) + 0.0 AS bandwidth FROM classed GROUP BY 1, 2""")
def f3_self_density(spark, sf_dir):
    got = density.fit(line_sides(spark, sf_dir), ["class_label", "hom_dim"], "qc")
    return got.select("class_label", "hom_dim", "n", "distinct_values", r6("least").alias("least"), r6("most").alias("most"), r6("bandwidth").alias("bandwidth"))


@query(f"""WITH {MTD}, v AS (SELECT pair, hom_dim, class_label, round(qc, 9) AS qc FROM classed)
SELECT pair, hom_dim, round(1 - (rank() OVER (PARTITION BY class_label, hom_dim ORDER BY qc) - 1) / count(*) OVER (PARTITION BY class_label, hom_dim), 6) + 0.0 AS tail FROM v""")
def f4_membership_ecdf(spark, sf_dir):
    rows = line_sides(spark, sf_dir).select("pair", "hom_dim", "class_label", "qc")
    return density.ecdf_tail(rows, rows.select("class_label", "hom_dim", "qc"), ["class_label", "hom_dim"], "qc").select("pair", "hom_dim", r6("tail").alias("tail"))


VARIATION = SERIES + ", tv AS (SELECT series_id, label, round(list_sum(list_transform(generate_series(2, 64), lambda i: abs(v[i] - v[i - 1]))), 6) AS value FROM series)"


def variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, label, value): the summed absolute steps of each series."""
    v = F.col("values")
    steps = F.zip_with(F.slice(v, 2, 63), F.slice(v, 1, 63), lambda a, b: F.abs(a - b))
    return vector_series(spark, sf_dir).select("series_id", "label", F.round(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), 6).alias("value"))


@query(f"""WITH {VARIATION}, w AS (SELECT label, max(value) AS most, sqrt(2 * sum(value * value) / (2 * count(*) - 1)) * pow(2 * count(*), -0.2) AS h FROM tv GROUP BY label),
grid AS (SELECT label, h, most, i, i * (1.2 * most + 1e-6) / 511 AS g FROM w, generate_series(0, 511) s(i)),
dens AS (SELECT grid.label, i, g, sum(exp(-0.5 * pow((g - value) / h, 2)) + exp(-0.5 * pow((g + value) / h, 2))) AS d FROM grid JOIN tv USING (label) GROUP BY ALL),
cdf AS (SELECT label, i, g, sum(d) OVER (PARTITION BY label ORDER BY i) / sum(d) OVER (PARTITION BY label) AS c FROM dens)
SELECT series_id, round(1 - max(c), 5) + 0.0 AS tail FROM tv JOIN cdf ON tv.label = cdf.label AND g < value GROUP BY series_id""")
def f5_membership_kde(spark, sf_dir):
    rows = variation(spark, sf_dir)
    sampled = density.sample(rows, ["label"])
    got = density.kde_tail(rows, density.curves(sampled, density.fit(sampled, ["label"]), ["label"]), ["label"])
    return got.select("series_id", (F.round("tail", 5) + F.lit(0.0)).alias("tail"))


@query(f"""WITH {VARIATION}, s AS (SELECT * FROM tv WHERE label < 5) SELECT t.series_id, round(coalesce(1 - (SELECT count(*) FROM s WHERE s.label = t.label AND s.value < t.value) / nullif((SELECT count(*) FROM s WHERE s.label = t.label), 0), 1.0), 6) + 0.0 AS membership FROM tv t""")
def f6_missing_density(spark, sf_dir):
    rows = variation(spark, sf_dir)
    known = rows.where("label < 5")
    tails = density.ecdf_tail(rows.join(known.select("label").distinct(), "label"), known.select("label", "value"), ["label"]).select("series_id", "tail")
    return rows.join(tails, "series_id", "left").select("series_id", r6(features.membership()).alias("membership"))


@query("""SELECT class_label, CAST(h AS INTEGER) AS hom_dim, rep, 'class_' || class_label || '_' || rep || '_h' || h || '_' || suffix AS feature, block FROM (SELECT DISTINCT label AS class_label FROM embeddings), (VALUES (0), (1)) d(h),
(VALUES ('mtd'), ('total_persistence'), ('pers_entropy'), ('landscape_l2'), ('betti_0'), ('betti_1'), ('betti_2')) r(rep), (VALUES ('qc', 'B1'), ('cq', 'B1'), ('asym', 'B2'), ('membership', 'B3')) b(suffix, block)""")
def f7_feature_meta(spark, sf_dir):
    classes = [r[0] for r in table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label").collect()]
    return features.feature_meta(spark, classes, (0, 1), barcodes.REPS).select("class_label", "hom_dim", "rep", "feature", "block")


@query(f"""WITH {VARIATION} SELECT series_id, 'class_' || label || '_tv_h0_' || suffix AS feature, round(CASE suffix WHEN 'qc' THEN value WHEN 'cq' THEN value * 2 WHEN 'asym' THEN value - value * 2 ELSE 1.0 END, 6) + 0.0 AS value FROM tv, (VALUES ('qc'), ('cq'), ('asym'), ('membership')) b(suffix)""")
def f7_long_features(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("value", r6("value"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = variation(spark, sf_dir).select("series_id", F.col("label").alias("class_label"), F.lit("tv").alias("rep"), F.lit(0).alias("hom_dim"), v.alias("qc"), (v * 2).alias("cq"), (v - v * 2).alias("asym"), F.lit(1.0).alias("membership"))
    return features.long_features(rows)


@query(f"""WITH {VARIATION} SELECT series_id, {", ".join(f"round(coalesce(max(value) FILTER (label = {c}), 0.0), 6) + 0.0 AS class_{c}_tv_h0_qc" for c in range(10))} FROM tv GROUP BY series_id""")
def f7_wide_features(spark, sf_dir):
    names = [f"class_{c}_tv_h0_qc" for c in range(10)]
    got = features.wide(_long(spark, sf_dir), names)
    return got.select("series_id", *(r6(n).alias(n) for n in names))


@query(f"""WITH {VARIATION} SELECT series_id, 'class_' || label || '_tv_h0_asym' AS feature, round(value - value * 2, 6) + 0.0 AS value FROM tv""")
def p9_block_selector(spark, sf_dir):
    classes = [r[0] for r in table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label").collect()]
    meta = features.feature_meta(spark, classes, (0,), ("tv",))
    return embedding.block_features(_long(spark, sf_dir), meta, "B2").select("series_id", "feature", r6("value").alias("value"))


# --- Baselines ---

STATS = """
WITH {series}, e AS (SELECT series_id, CAST(i - 1 AS INTEGER) AS t, v[i] AS x FROM series, generate_series(1, len(v)) g(i)),
m AS (SELECT series_id, count(*) AS n, avg(x) AS mu, max(x) AS hi, min(x) AS lo, stddev_pop(x) AS sd FROM e GROUP BY 1),
l AS (SELECT e.*, n, mu, hi, lo, sd, lag(x) OVER w AS p, lead(x) OVER w AS q, lead(x, 2) OVER w AS q2, lead(x, 4) OVER w AS q4, row_number() OVER w - row_number() OVER (PARTITION BY series_id, x > mu ORDER BY t) AS island FROM e JOIN m USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY t)),
runs AS (SELECT series_id, max(k) FILTER (up) AS above, max(k) FILTER (NOT up) AS below FROM (SELECT series_id, x > mu AS up, island, count(*) AS k FROM l GROUP BY 1, 2, 3) GROUP BY 1),
a AS (SELECT series_id, sum(x) AS sum_values, sum(x * x) AS abs_energy, any_value(mu) AS mean, quantile_cont(x, 0.5) AS median, var_pop(x) AS variance, any_value(sd) AS standard_deviation,
avg(pow(x - mu, 3)) / pow(var_pop(x), 1.5) AS skew, avg(pow(x - mu, 4)) / pow(var_pop(x), 2) - 3 AS kurtosis, sqrt(avg(x * x)) AS root_mean_square, any_value(lo) AS minimum, any_value(hi) AS maximum,
quantile_cont(x, 0.1) AS quantile_10, quantile_cont(x, 0.9) AS quantile_90, (arg_max(x, t) - arg_min(x, t)) / (any_value(n) - 1) AS mean_change, sum(abs(x - p)) / (any_value(n) - 1) AS mean_abs_change,
sum(abs(x - p)) AS abs_sum_changes, count(*) FILTER (x > mu) AS count_above_mean, count(*) FILTER (x < mu) AS count_below_mean, min(t) FILTER (x = hi) / any_value(n) AS first_location_of_maximum,
1 - (any_value(n) - 1 - max(t) FILTER (x = lo)) / any_value(n) AS last_location_of_minimum, count(*) FILTER ((x > 0) <> (p > 0)) AS crossings_of_0, count(*) FILTER (x > p AND x > q) AS peaks, sqrt(sum((x - p) * (x - p))) AS cid_ce,
count(*) FILTER (abs(x - mu) > 2 * sd) / any_value(n) AS ratio_beyond_sigma, regr_slope(x, t) AS linear_trend_slope, avg((x - mu) * (q - mu)) / var_pop(x) AS autocorrelation_1,
avg(x * q2 * q4) AS c3_2, avg(q4 * q4 * q2 - q2 * x * x) AS time_reversal_2 FROM l GROUP BY 1)
SELECT a.series_id, CAST(coalesce(above, 0) AS DOUBLE) AS longest_strike_above_mean, {columns} FROM a JOIN runs USING (series_id)
"""
STAT_NAMES = (
    "sum_values", "abs_energy", "mean", "median", "variance", "standard_deviation", "skew", "kurtosis", "root_mean_square", "minimum", "maximum", "quantile_10", "quantile_90", "mean_change", "mean_abs_change",
    "abs_sum_changes", "count_above_mean", "count_below_mean", "first_location_of_maximum", "last_location_of_minimum", "crossings_of_0", "peaks", "cid_ce", "ratio_beyond_sigma", "linear_trend_slope", "autocorrelation_1", "c3_2", "time_reversal_2",
)


@query(STATS.format(series=SERIES, columns=", ".join(f"round(CAST({n} AS DOUBLE), 5) + 0.0 AS {n}" for n in STAT_NAMES)))
def g1_descriptive_statistics(spark, sf_dir):
    got = baselines.descriptive(vector_series(spark, sf_dir))
    return got.select("series_id", "longest_strike_above_mean", *((F.round(n, 5) + F.lit(0.0)).alias(n) for n in STAT_NAMES))


@query()
def g1_spectrum(spark, sf_dir):
    return baselines.spectrum(event_series(spark, sf_dir))


@query()
def g2_canonical_features(spark, sf_dir):
    return baselines.canonical(event_series(spark, sf_dir))


PLANE = POINTS + ", e AS (SELECT series_id, j, var_pop(coords[j]) AS s FROM points, generate_series(1, 3) g(j) GROUP BY 1, 2)"


@query(f"WITH {PLANE} SELECT series_id, CAST(10 AS DOUBLE) AS n_points, round(sum(s), 5) + 0.0 AS total_variance FROM e GROUP BY 1")
def g3_cloud_statistics(spark, sf_dir):
    """In three dimensions the three axes' variances add up to the cloud's."""
    rows = embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE).withColumn("points", F.transform("points", lambda p: F.slice(p, 1, 3)))
    got = baselines.cloud_statistics(rows)
    return got.select("series_id", "n_points", (F.round(sum(F.pow(f"std_{k}", F.lit(2)) for k in range(3)), 5) + F.lit(0.0)).alias("total_variance"))


@query()
def g3_cloud_axes(spark, sf_dir):
    return baselines.cloud_statistics(embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE))


@query(f"""WITH {SERIES} SELECT series_id, 1.0::DOUBLE AS s_t, round(v[64] - v[1], 6) + 0.0 AS s_x, 0.5::DOUBLE AS s_tt, round(list_sum(list_transform(generate_series(1, 63), lambda i: (i - 0.5) / 63 * (v[i + 1] - v[i]))), 6) + 0.0 AS s_tx,
round(list_sum(list_transform(generate_series(1, 63), lambda i: ((v[i] + v[i + 1]) / 2 - v[1]) / 63)), 6) + 0.0 AS s_xt, round((v[64] - v[1]) * (v[64] - v[1]) / 2, 6) + 0.0 AS s_xx FROM series""")
def g4_path_signature(spark, sf_dir):
    got = baselines.signature(vector_series(spark, sf_dir))
    return got.select("series_id", *(r6(c).alias(c) for c in got.columns[1:]))


@query(f"""WITH {SERIES}, c AS (SELECT series_id, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM series),
r AS (SELECT series_id, list_sum(list_transform(c, lambda x: x * x)) / 64 AS r0, list_sum(list_transform(generate_series(1, 63), lambda i: c[i] * c[i + 1])) / 64 AS r1, list_sum(list_transform(generate_series(1, 62), lambda i: c[i] * c[i + 2])) / 64 AS r2 FROM c),
o AS (SELECT series_id, (v[i] <= v[i + 1])::INT * 4 + (v[i + 1] <= v[i + 2])::INT * 2 + (v[i] <= v[i + 2])::INT AS o FROM series, generate_series(1, 62) g(i)),
e AS (SELECT series_id, -sum(n / 62.0 * ln(n / 62.0)) AS e FROM (SELECT series_id, o, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT series_id, round(r1 * (r0 - r2) / (r0 * r0 - r1 * r1), 6) + 0.0 AS ar_1, round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 6) + 0.0 AS ar_2, round(e, 6) + 0.0 AS permutation_entropy FROM r JOIN e USING (series_id)""")
def g1_dynamics(spark, sf_dir):
    """Two autoregression coefficients and the entropy of orders of three."""
    return baselines.dynamics(vector_series(spark, sf_dir), 2).select("series_id", *(r6(c).alias(c) for c in ("ar_1", "ar_2", "permutation_entropy")))


@query()
def g1_all_dynamics(spark, sf_dir):
    return baselines.dynamics(event_series(spark, sf_dir))


@query(f"""WITH {SERIES}, p AS (SELECT series_id, i, [v[i], v[i + 4], v[i + 8]] AS c FROM series, generate_series(1, 56) g(i)),
d AS (SELECT series_id, i, list_transform([1, 2, 3], lambda k: c[k] - lag(c) OVER w [k]) AS d, list_transform([1, 2, 3], lambda k: lag(c) OVER w [k] - first_value(c) OVER w [k]) AS s FROM p WINDOW w AS (PARTITION BY series_id ORDER BY i)),
t AS (SELECT series_id, a, b, sum(s[a] * d[b] + d[a] * d[b] / 2) AS s2, sum(d[a]) AS x, sum(d[b]) AS y FROM d, generate_series(1, 3) g(a), generate_series(1, 3) h(b) WHERE d[1] IS NOT NULL GROUP BY 1, 2, 3)
SELECT series_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(s2, 5) + 0.0 AS s2, round(s2 - x * y / 2, 5) + 0.0 AS log2 FROM t""")
def g4_cloud_signature(spark, sf_dir):
    """The path of each series through its three-dimensional cloud."""
    got = baselines.cloud_signature(embedding.embed(vector_series(spark, sf_dir), 4, 3, 1))
    cells = F.array(*(F.struct(F.lit(i + 1).alias("a"), F.lit(j + 1).alias("b"), F.get("s2", F.lit(i * 3 + j)).alias("s2"), (F.get("s2", F.lit(i * 3 + j)) - F.get("s", F.lit(i)) * F.get("s", F.lit(j)) / 2).alias("log2")) for i in range(3) for j in range(3)))
    return got.select("series_id", F.explode(cells).alias("x")).select("series_id", "x.a", "x.b", (F.round("x.s2", 5) + F.lit(0.0)).alias("s2"), (F.round("x.log2", 5) + F.lit(0.0)).alias("log2"))


# --- Evaluation ---

MODULES = ["a", "b", "c"]
PROBA = SERIES + """, w AS (SELECT series_id, label, m, CAST(c AS INTEGER) AS class_label, abs(v[m * 10 + c + 1]) + 1e-9 AS w FROM series, generate_series(0, 2) x(m), generate_series(0, 9) y(c)),
proba AS (SELECT series_id, label, chr(CAST(97 + m AS INTEGER)) AS module, class_label, w / sum(w) OVER (PARTITION BY series_id, m) AS p FROM w),
single AS (SELECT module, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM (SELECT series_id, label, module, class_label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY series_id, module ORDER BY p DESC, class_label) AS r FROM proba) WHERE r = 1) GROUP BY 1),
weights AS (SELECT module, accuracy, pow(accuracy, 4) / sum(pow(accuracy, 4)) OVER () AS weight FROM single)"""


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.transform(F.slice("values", 1, 30), lambda x: F.abs(x) + 1e-9)
    return evaluate.probability_rows(vector_series(spark, sf_dir), weights, MODULES, 10)


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(evaluate.argmax(proba(spark, sf_dir), ["series_id", "label", "module"]), "module")


@query(f"WITH {PROBA} SELECT module, round(accuracy, 6) + 0.0 AS accuracy, n FROM single")
def e2_accuracy(spark, sf_dir):
    return single(spark, sf_dir).withColumn("accuracy", r6("accuracy"))


@query("SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat('11:', doc_id)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def e3_stratified_folds(spark, sf_dir):
    return evaluate.folds(table(spark, sf_dir, "labels"), 5, 11, "doc_id", "quality").select("doc_id", "quality", "fold")


@query(f"WITH {PROBA} SELECT series_id, class_label, round(avg(p), 6) + 0.0 AS p FROM proba GROUP BY 1, 2")
def e6_uniform_fusion(spark, sf_dir):
    return evaluate.fuse_uniform(proba(spark, sf_dir), ["series_id"]).withColumn("p", r6("p"))


@query(f"WITH {PROBA} SELECT module, round(accuracy, 6) + 0.0 AS accuracy, round(weight, 6) + 0.0 AS weight FROM weights")
def e7_power_weights(spark, sf_dir):
    got = evaluate.cawpe_weights(single(spark, sf_dir), [])
    return got.select("module", r6("accuracy").alias("accuracy"), r6("weight").alias("weight"))


@query(f"WITH {PROBA} SELECT series_id, class_label, round(sum(weight * p), 6) + 0.0 AS p FROM proba JOIN weights USING (module) GROUP BY 1, 2")
def e8_weighted_fusion(spark, sf_dir):
    rows = proba(spark, sf_dir)
    weights = evaluate.cawpe_weights(single(spark, sf_dir), [])
    return evaluate.fuse_weighted(rows, weights, ["series_id"], ["module"]).withColumn("p", r6("p"))


@query(f"WITH {PROBA} SELECT series_id, module, class_label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY series_id, module ORDER BY p DESC, class_label) AS r FROM proba) WHERE r = 1")
def e9_argmax(spark, sf_dir):
    return evaluate.argmax(proba(spark, sf_dir), ["series_id", "module"])


@query(f"""WITH {PROBA} SELECT series_id, {", ".join(f"round(max(p) FILTER (module = '{m}' AND class_label = {c}), 6) + 0.0 AS p_{m}_{c}" for m in MODULES for c in range(10))} FROM proba GROUP BY 1""")
def e10_stacking_matrix(spark, sf_dir):
    got = evaluate.stacking_matrix(proba(spark, sf_dir), ["series_id"], MODULES, list(range(10)))
    return got.select("series_id", *(r6(c).alias(c) for c in got.columns[1:]))


# --- Reports ---

METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(f"WITH {ACC} SELECT dataset_type IN ('ASIA', 'EUROPE') AS is_dynamical, method, round(avg(holdout_accuracy), 6) + 0.0 AS mean_accuracy, count(*) AS n FROM acc GROUP BY 1, 2")
def r1_accuracy_by_type(spark, sf_dir):
    rows = accuracy_rows(spark, sf_dir).withColumn("is_dynamical", F.col("dataset_type").isin("ASIA", "EUROPE"))
    return reports.by_type(rows).withColumn("mean_accuracy", r6("mean_accuracy"))


SUMMARY = ACC + """, means AS (SELECT dataset, method, avg(holdout_accuracy) AS mean FROM acc WHERE NOT (dataset = 'FRANCE' AND method = '2-HIGH') GROUP BY 1, 2), names AS (SELECT DISTINCT dataset FROM means)"""
CELLS = ", ".join(f"round({{f}}(mean) FILTER (method = '{m}'), 6) + 0.0 AS {n}" for m, n in zip(METHODS, ("urgent", "high", "medium"), strict=True))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accuracy_rows(spark, sf_dir).where("not (dataset = 'FRANCE' and method = '2-HIGH')")
    got = reports.wide_summary(rows, METHODS)
    return got.select("dataset", *(r6(F.col(f"`{m}`")).alias(n) for m, n in zip(METHODS, ("urgent", "high", "medium"), strict=True)))


@query(f"WITH {SUMMARY} SELECT dataset, {CELLS.format(f='max')} FROM means GROUP BY 1 HAVING count(*) FILTER (method IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) > 0")
def r2_mean_holdout_wide(spark, sf_dir):
    return _summary(spark, sf_dir).where("dataset <> 'MEAN'")


@query(f"WITH {SUMMARY} SELECT 'MEAN' AS dataset, {CELLS.format(f='avg')} FROM means")
def r3_mean_row(spark, sf_dir):
    return _summary(spark, sf_dir).where("dataset = 'MEAN'")


@query(f"""WITH {ACC}, d AS (SELECT DISTINCT dataset FROM acc UNION ALL SELECT 'MEAN'),
m AS (SELECT n_name AS dataset, CASE WHEN n_nationkey % 3 = 0 THEN 'second:' || n_regionkey ELSE 'first:' || n_name END AS origin, n_nationkey AS rank FROM nation)
SELECT d.dataset, CASE WHEN d.dataset = 'MEAN' THEN NULL ELSE m.rank END AS rank, m.origin FROM d LEFT JOIN m USING (dataset)""")
def r4_ordered_summary(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    first = n.select(F.col("n_name").alias("dataset"), F.lit(0).alias("source_rank"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("first:"), "n_name")).alias("origin"))
    second = n.select(F.col("n_name").alias("dataset"), F.lit(1).alias("source_rank"), F.concat(F.lit("second:"), F.col("n_regionkey").cast("string")).alias("origin"))
    order = n.select(F.col("n_name").alias("dataset"), F.col("n_nationkey").alias("rank"))
    summary = reports.wide_summary(accuracy_rows(spark, sf_dir), METHODS)
    return reports.in_order(summary, order, first.unionByName(second), ["origin"]).select("dataset", "rank", "origin")


@query(f"WITH {ACC} SELECT dataset, dataset_type, method, CAST(seed AS INTEGER) AS seed, round(holdout_accuracy, 6) + 0.0 AS holdout_accuracy FROM acc")
def s4_accuracy_sink(spark, sf_dir):
    path = f"{work_dir(spark)}/accuracy"
    sinks.write_table(accuracy_rows(spark, sf_dir), path, sinks.ACCURACY)
    got = spark.read.parquet(path)
    return got.select("dataset", "dataset_type", "method", "seed", r6("holdout_accuracy").alias("holdout_accuracy"))


@query(f"WITH {ACC} SELECT dataset, CAST(seed AS INTEGER) AS seed, count(*) AS n, round(sum(holdout_accuracy), 6) + 0.0 AS total FROM acc GROUP BY 1, 2")
def s5_split_sink(spark, sf_dir):
    """Rows appended by (dataset, seed), one half of the seeds twice: a split is replaced, not doubled."""
    path = f"{work_dir(spark)}/split"
    rows = accuracy_rows(spark, sf_dir).withColumn("dataset", F.concat(F.lit("n_"), "dataset"))
    sinks.append_split(rows, path)
    sinks.append_split(rows.where("seed % 2 = 0"), path)
    got = spark.read.parquet(path).withColumn("dataset", F.expr("substring(dataset, 3)"))
    return got.groupBy("dataset", "seed").agg(F.count("*").alias("n"), r6(F.sum("holdout_accuracy")).alias("total"))


@query(f"WITH {PROBA} SELECT module, class_label, count(*) AS n, round(sum(p), 5) + 0.0 AS total FROM proba GROUP BY 1, 2")
def s6_probability_sink(spark, sf_dir):
    path = f"{work_dir(spark)}/proba"
    sinks.append_split(proba(spark, sf_dir).withColumn("dataset", F.lit("vectors")).withColumn("seed", F.lit(0)), path)
    got = spark.read.parquet(path)
    return got.groupBy("module", "class_label").agg(F.count("*").alias("n"), (F.round(F.sum("p"), 5) + F.lit(0.0)).alias("total"))


# --- Independence ---


def blocks(spark: SparkSession, sf_dir: str, p: int = 8) -> DataFrame:
    """(row_id, label, x, y): the first p values of an embedding and the rest."""
    s = vector_series(spark, sf_dir)
    return s.select(F.col("series_id").alias("row_id"), "label", F.slice("values", 1, p).alias("x"), F.slice("values", p + 1, 64).alias("y"))


FOLDED = SERIES + ", folded AS (SELECT series_id AS row_id, v, CAST((row_number() OVER (ORDER BY md5(concat('2:', series_id)), series_id) - 1) % greatest(2, least(5, (SELECT count(*) FROM series) // 4)) AS INTEGER) AS fold FROM series)"


@query(f"WITH {FOLDED} SELECT row_id, fold FROM folded")
def i1_shuffled_folds(spark, sf_dir):
    return independence.assign_folds(blocks(spark, sf_dir), 2).select("row_id", "fold")


@query(f"""WITH {FOLDED}, e AS (SELECT row_id, fold, CAST(j - 1 AS INTEGER) AS slot, v[j] AS value FROM folded, generate_series(1, 8) g(j)),
k AS (SELECT f.fold, slot, avg(value) AS mu, stddev_pop(value) AS sd FROM e JOIN (SELECT DISTINCT fold FROM folded) f ON e.fold <> f.fold GROUP BY 1, 2)
SELECT row_id, e.slot, round((value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 5) + 0.0 AS z FROM e JOIN k ON e.fold = k.fold AND e.slot = k.slot""")
def i2_standardise(spark, sf_dir):
    rows = independence.assign_folds(blocks(spark, sf_dir), 2)
    return independence.standardised(rows, "x").select("row_id", "slot", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query(f"""WITH {FOLDED}, k AS (SELECT f.fold, count(*) AS n, avg(v[1]) AS mx, stddev_pop(v[1]) AS sx, avg(v[9]) AS my, stddev_pop(v[9]) AS sy, covar_pop(v[1], v[9]) AS c FROM folded e JOIN (SELECT DISTINCT fold FROM folded) f ON e.fold <> f.fold GROUP BY 1),
r AS (SELECT v[1] AS x, v[1] - mx - sx * (c / (sx * sy)) / (1 + 1.0 / n) * (v[9] - my) / sy AS e FROM folded JOIN k USING (fold))
SELECT CAST(0 AS INTEGER) AS slot, round(least(greatest(1 - sum(e * e) / (var_pop(x) * count(*)), 0.0), 1.0), 5) + 0.0 AS r2 FROM r""")
def i4_explained_r2_single(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("row_id", F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))
    return independence.explained_r2(independence.assign_folds(rows, 2)).select("slot", (F.round("r2", 5) + F.lit(0.0)).alias("r2"))


@query()
def i4_explained_r2(spark, sf_dir):
    return independence.explained_r2(independence.assign_folds(blocks(spark, sf_dir), 2))


@query()
def i5_canonical_correlation(spark, sf_dir):
    rho = independence.canonical_correlation(independence.assign_folds(blocks(spark, sf_dir), 2))
    return blocks(spark, sf_dir).agg(F.count("*").alias("n"), F.lit(rho).alias("mean_rho"))


RHO = FOLDED + ", rho AS (SELECT fold, abs(corr(v[1], v[9])) AS rho FROM folded GROUP BY 1)"


@query(f"WITH {RHO} SELECT (SELECT count(*) FROM series) AS n, round(avg(rho), 6) + 0.0 AS mean_rho FROM rho")
def i5_canonical_correlation_single(spark, sf_dir):
    """Of one column with one: the correlation itself, in each held-out fold."""
    rows = blocks(spark, sf_dir).select("row_id", F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))
    rho = independence.canonical_correlation(independence.assign_folds(rows, 2))
    return rows.agg(F.count("*").alias("n"), r6(F.lit(rho)).alias("mean_rho"))


#: Row a of replicate r has the partner of row b: itself in replicate 0, else the row of its place in another order.
DRAWN = """one AS (SELECT series_id, v, row_number() OVER (ORDER BY md5(concat('4:at:', series_id)), series_id) AS place FROM series),
too AS (SELECT r, series_id, v, row_number() OVER (PARTITION BY r ORDER BY md5(concat('4:', r, ':', series_id)), series_id) AS place FROM series, generate_series(1, 40) s(r)),
drawn AS (SELECT 0 AS r, series_id, v[1] AS x, v[9] AS y FROM series UNION ALL SELECT b.r, a.series_id, a.v[1], b.v[9] FROM one a JOIN too b USING (place))"""
NULLS = f"{SERIES}, {DRAWN}, stat AS (SELECT r, round(abs(corr(x, y)), 9) AS value FROM drawn GROUP BY 1)"
R2_NULLS = f"""{FOLDED}, {DRAWN}, d AS (SELECT r, x, y, fold FROM drawn JOIN folded ON row_id = series_id),
s AS (SELECT r, fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM d GROUP BY 1, 2),
t AS (SELECT r, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(yy) AS yy, sum(xy) AS xy FROM s GROUP BY 1),
k AS (SELECT s.r, fold, t.n - s.n AS n, (t.x - s.x) / (t.n - s.n) AS mx, (t.y - s.y) / (t.n - s.n) AS my, (t.xy - s.xy) / (t.n - s.n) AS xy, (t.yy - s.yy) / (t.n - s.n) AS yy FROM s JOIN t USING (r)),
e AS (SELECT r, x, x - mx - (xy - mx * my) / (yy - my * my) / (1 + 1.0 / n) * (y - my) AS e FROM d JOIN k USING (r, fold)),
stat AS (SELECT r, round(least(greatest(1 - sum(e * e) / (var_pop(x) * count(*)), 0.0), 1.0), 9) AS value FROM e GROUP BY 1)"""


@query(f"""WITH {NULLS} SELECT round(o.value, 6) + 0.0 AS value, round(avg(s.value), 6) + 0.0 AS null_mean, round((1 + count(*) FILTER (s.value >= o.value)) / (1 + count(*)), 6) + 0.0 AS p_value
FROM stat s, (SELECT value FROM stat WHERE r = 0) o WHERE s.r > 0 GROUP BY o.value""")
def i6_permutation_null(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("row_id", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))
    drawn = independence.permuted(rows, 40, 4)
    stat = drawn.groupBy("replicate").agg(F.round(F.abs(F.corr("x", "y")), 9).alias("value"))
    return independence.p_value(stat).select(*(r6(c).alias(c) for c in ("value", "null_mean", "p_value")))


@query(f"""WITH {R2_NULLS} SELECT round(o.value, 6) + 0.0 AS value, round(avg(s.value), 6) + 0.0 AS null_mean, round((1 + count(*) FILTER (s.value >= o.value)) / (1 + count(*)), 6) + 0.0 AS p_value
FROM stat s, (SELECT value FROM stat WHERE r = 0) o WHERE s.r > 0 GROUP BY o.value""")
def i6_null_of_r2(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("row_id", F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))
    stat = independence.null_values(independence.assign_folds(rows, 2), "r2", 40, 4).withColumn("value", F.round("value", 9))
    return independence.p_value(stat).select(*(r6(c).alias(c) for c in ("value", "null_mean", "p_value")))


@query()
def i6_nulls_of_blocks(spark, sf_dir):
    """Both metrics of whole blocks, the wide partner reduced to its principal axes within each fold."""
    rows, out = independence.assign_folds(blocks(spark, sf_dir).select("row_id", "x", "y"), 2), None
    for name in independence.METRICS:
        row = independence.p_value(independence.null_values(rows, name, 10, 4)).withColumn("metric", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {ACC} SELECT dataset, method AS block, dataset_type AS partner, 'r2' AS metric, round(avg(holdout_accuracy), 6) + 0.0 AS value, round(avg(holdout_accuracy / 2), 6) + 0.0 AS null_mean, round(median(holdout_accuracy * holdout_accuracy), 6) + 0.0 AS p_value FROM acc GROUP BY 1, 2, 3""")
def i7_over_seeds(spark, sf_dir):
    a = F.col("holdout_accuracy")
    rows = accuracy_rows(spark, sf_dir).select("dataset", F.col("method").alias("block"), F.col("dataset_type").alias("partner"), F.lit("r2").alias("metric"), a.alias("value"), (a / 2).alias("null_mean"), (a * a).alias("p_value"))
    got = independence.over_seeds(rows)
    return got.select("dataset", "block", "partner", "metric", *(r6(c).alias(c) for c in ("value", "null_mean", "p_value")))




# --- Operators that SQL expresses in part or not at all; tests hold the helpers of the barcodes against brute force ---


def small_clouds(spark: SparkSession, sf_dir: str, sizes: clouds.Sizes = FEW) -> DataFrame:
    """(pair keys, points, class_points): each series' cloud with each class's default subcloud."""
    s = vector_series(spark, sf_dir)
    own = clouds.series_clouds(embedding.embed(s, TAU, M, STRIDE), clouds.Sizes(1.0, 5, 500, 30))
    pool = clouds.pooled(own)
    sub = clouds.gathered(clouds.subclouds(pool, clouds.class_sizes(pool, sizes)), "label", "exclude_series")
    classes = [r[0] for r in s.select("label").distinct().orderBy("label").collect()]
    base = pairs.class_pairs(s.select("series_id", "label"), classes)
    return pairs.with_subclouds(base, sub).join(own.select("series_id", "points"), "series_id")


@query()
def p4_embedding_search(spark, sf_dir):
    """The parameters found on all series, with each user's number of points under them."""
    s = event_series(spark, sf_dir)
    tau, m, stride = embedding.search(s, 6, 6, sample=None)
    return s.select("series_id", F.lit(tau).alias("tau"), F.lit(m).alias("m"), F.lit(stride).alias("stride"), embedding.n_points(F.size("values"), tau, m, stride).alias("n_points"))


@query()
def p5_projection(spark, sf_dir):
    rows = embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE)
    return rows.select("series_id", F.posexplode(embedding.Projection.fit(rows)("points")).alias("point_idx", "coords"))


@query(f"""WITH {POINTS}, mu AS (SELECT j, avg(coords[j]) AS mu FROM points, generate_series(1, 10) g(j) GROUP BY 1)
SELECT series_id, round(sum((coords[j] - mu) * (coords[j] - mu)), 5) + 0.0 AS spread FROM points, mu GROUP BY 1""")
def p5_projection_on_all_axes(spark, sf_dir):
    """All axes keep each point's distance from the mean."""
    rows = embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE)
    square = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
    spread = F.aggregate(embedding.Projection.fit(rows, M)("points"), F.lit(0.0), lambda a, p: a + square(p))
    return rows.select("series_id", (F.round(spread, 5) + F.lit(0.0)).alias("spread"))


@query(f"""WITH {POINTS}, c AS (SELECT label, coords FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY series_id) AS r FROM points WHERE point_idx = 0) WHERE r <= 5)
SELECT series_id, c.label AS class_label, 1::BIGINT AS n_bars, round(min(sqrt(list_sum(list_transform(generate_series(1, 10), lambda j: (p.coords[j] - c.coords[j]) * (p.coords[j] - c.coords[j]))))), 6) + 0.0 AS death
FROM points p, c WHERE p.point_idx = 0 GROUP BY 1, 2 HAVING min(list_sum(list_transform(generate_series(1, 10), lambda j: abs(p.coords[j] - c.coords[j])))) > 0""")
def x1_single_points(spark, sf_dir):
    """A cloud of one point has one bar: its distance from the nearest point of the class, unless it is one of them."""
    rows = embedding.embed(vector_series(spark, sf_dir), TAU, M, STRIDE).select("series_id", "label", F.slice("points", 1, 1).alias("points"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("series_id"))
    classes = rows.withColumn("_r", first).where("_r <= 5").groupBy(F.col("label").alias("class_label")).agg(F.flatten(F.collect_list("points")).alias("class_points"))
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    met = pairs.class_pairs(rows, labels, training=False).join(classes, "class_label").join(rows.select("series_id", "points"), "series_id")
    got = barcodes.cross_barcodes(met, ["series_id", "class_label"])
    bars = got.select("series_id", "class_label", F.explode("bars").alias("b")).where("b.direction = 'qc'")
    return bars.groupBy("series_id", "class_label").agg(F.count("*").alias("n_bars"), r6(F.max("b.death")).alias("death"))


@query()
def t2_maxmin_subsample(spark, sf_dir):
    rows = embedding.embed(event_series(spark, sf_dir), 2, 3, 1)
    return clouds.maxmin_sample(rows, F.lit(30)).select("series_id", F.posexplode("points").alias("point_idx", "coords"))


GREEDY = """RECURSIVE {points}, apart AS (SELECT p.g, p.i, p.c, (p.c[1] - f.c[1]) ** 2 + (p.c[2] - f.c[2]) ** 2 + (p.c[3] - f.c[3]) ** 2 AS near, 1 AS step, f.i AS chosen FROM p JOIN first f USING (g)
UNION ALL SELECT g, i, c, least(near, (c[1] - b[1]) ** 2 + (c[2] - b[2]) ** 2 + (c[3] - b[3]) ** 2), step + 1, bi FROM
(SELECT *, first_value(c) OVER w AS b, first_value(i) OVER w AS bi FROM apart WHERE step < {size} WINDOW w AS (PARTITION BY g ORDER BY near DESC, i))),
picked AS (SELECT DISTINCT g, step, chosen AS i FROM apart)"""
SERIES_POINTS = SERIES + """, p AS (SELECT series_id AS g, i - 1 AS i, [v[i], v[i + 4], v[i + 8]] AS c FROM series, generate_series(1, 56) s(i)),
first AS (SELECT p.* FROM p WHERE i = CAST('0x' || substr(md5(concat('0:', g)), 1, 8) AS BIGINT) % 56)"""


@query(f"""WITH {GREEDY.format(points=SERIES_POINTS, size=20)} SELECT g AS series_id, CAST(step - 1 AS INTEGER) AS place, round(c[1], 6) + 0.0 AS x, round(c[2], 6) + 0.0 AS y, round(c[3], 6) + 0.0 AS z FROM picked JOIN p USING (g, i)""")
def t2_farthest_points(spark, sf_dir):
    """The 20 farthest points of each series' cloud in the order they are chosen; the greedy choice as a recursive query."""
    got = clouds.maxmin_sample(embedding.embed(vector_series(spark, sf_dir), 4, 3, 1), F.lit(20)).select("series_id", F.posexplode("points").alias("place", "p"))
    return got.select("series_id", "place", *(r6(F.get("p", F.lit(k))).alias(n) for k, n in enumerate("xyz")))


CLASS_POINTS = SERIES + """, raw AS (SELECT label AS g, series_id, i, [v[3 * i + 1], v[3 * i + 5], v[3 * i + 9]] AS c FROM series, generate_series(0, 18) s(i)),
p AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY series_id, i) AS i, series_id, c, md5(concat('0:', g, ':', series_id, ':', i)) AS o FROM raw), first AS (SELECT g, arg_min(i, o) AS i, arg_min(c, o) AS c FROM p GROUP BY g)"""


@query(f"""WITH {GREEDY.format(points=CLASS_POINTS, size=40)}, sums AS (SELECT g, count(*) AS n, count(DISTINCT series_id) AS owners, round(sum(c[1] * step), 4) + 0.0 AS total FROM picked JOIN p USING (g, i) GROUP BY 1)
SELECT CAST(g AS INTEGER) AS label, n, owners + 1 AS subclouds, total FROM sums""")
def t6_farthest_subclouds(spark, sf_dir):
    """Of each class's 40 farthest points: a sum that tells their order, and how many subclouds there are, the class's and those of series that own a point."""
    pool = clouds.pooled(embedding.embed(vector_series(spark, sf_dir), 4, 3, 3))
    sizes = pool.select("label").distinct().withColumn("size", F.lit(40))
    got = clouds.class_subclouds(pool, sizes)
    total = F.aggregate(F.transform("points", lambda p, k: F.get(p, F.lit(0)) * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    counted = got.groupBy("label").agg(F.count("*").alias("subclouds"))
    whole = got.where("exclude_series is null").select("label", F.size("points").cast("long").alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("total"))
    return whole.join(counted, "label").select("label", "n", "subclouds", "total")


@query("""WITH n AS (SELECT DISTINCT label, 4 + 3 * label AS length FROM embeddings), grid AS (SELECT * FROM n, generate_series(1, 4) a(t), generate_series(1, 10) b(d), generate_series(1, 3) c(s) WHERE (d - 1) * t + 1 <= length),
best AS (SELECT label, length, arg_max({'t': t, 'd': d, 's': s}, [CASE WHEN (length - (d - 1) * t - 1) // s >= 5 THEN 1 ELSE 0 END, s, d, t]) AS b FROM grid GROUP BY ALL)
SELECT e.label, CAST(b.t AS INTEGER) AS tau, CAST(b.d AS INTEGER) AS m, CAST(b.s AS INTEGER) AS stride, sum((length - (b.d - 1) * b.t - 1) // b.s + 1)::BIGINT AS points FROM embeddings e JOIN best USING (label) GROUP BY ALL""")
def f8_embedding_stage(spark, sf_dir):
    """The embedding that fitting settles on for a dataset of each class's series, cut to between 4 and 31 values, and the points it gives."""
    s, out = vector_series(spark, sf_dir), None
    for (label,) in s.select("label").distinct().collect():
        rows = s.where(F.col("label") == label).withColumn("values", F.slice("values", 1, 4 + 3 * label))
        c = class_features.fit_embedding(rows, class_features.LITE)
        points = embedding.embed(rows, c.tau, c.m, c.stride).agg(F.sum(F.size("points")).alias("points"))
        row = points.select(F.lit(label).alias("label"), *(F.lit(x).alias(n) for n, x in (("tau", c.tau), ("m", c.m), ("stride", c.stride))), "points")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def x1_cross_barcodes_h0(spark, sf_dir):
    got = barcodes.cross_barcodes(small_clouds(spark, sf_dir), ["series_id", "class_label"])
    return got.select("series_id", "class_label", F.explode("bars").alias("b")).select("series_id", "class_label", "b.*")


@query()
def x2_cross_barcodes_h1(spark, sf_dir):
    """Loops of every series' cloud with every class cloud of the full size (0.8 of the points, up to 1,000), both ways."""
    s = vector_series(spark, sf_dir)
    own = clouds.series_clouds(embedding.embed(s, TAU, M, STRIDE), clouds.Sizes(most=500))
    pool = clouds.pooled(own)
    sub = clouds.class_subclouds(pool, clouds.class_sizes(pool, clouds.Sizes()), mode="uniform").where("exclude_series is null")
    shared = {r.label: r.points for r in sub.collect()}
    rows = own.select("series_id", "label", "points", F.lit(None).cast("array<array<double>>").alias("own"), F.array(*map(F.lit, sorted(shared))).alias("wanted"))
    got = barcodes.class_barcodes(rows, ["series_id"], shared, loops=True)
    return barcodes.slots(got, ["series_id", "class_label"], (1,)).select("series_id", "class_label", "direction", F.size("bars").alias("n_bars"), F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["death"] - b["birth"]).alias("total"))


FOUR = SERIES + """, p AS (SELECT series_id, k, [v[16 * k + 1], v[16 * k + 2], v[16 * k + 3]] AS c FROM series, generate_series(0, 3) g(k)),
d AS (SELECT a.series_id, max(CASE WHEN a.k = 0 AND b.k = 1 THEN e END) AS d01, max(CASE WHEN a.k = 0 AND b.k = 2 THEN e END) AS d02, max(CASE WHEN a.k = 0 AND b.k = 3 THEN e END) AS d03, max(CASE WHEN a.k = 1 AND b.k = 2 THEN e END) AS d12, max(CASE WHEN a.k = 1 AND b.k = 3 THEN e END) AS d13, max(CASE WHEN a.k = 2 AND b.k = 3 THEN e END) AS d23
FROM p a JOIN p b ON a.series_id = b.series_id AND a.k < b.k, LATERAL (SELECT sqrt((a.c[1] - b.c[1]) ** 2 + (a.c[2] - b.c[2]) ** 2 + (a.c[3] - b.c[3]) ** 2) AS e) GROUP BY 1),
rings AS (SELECT series_id, greatest(d01, d12, d23, d03) AS birth, least(d02, d13) AS death FROM d UNION ALL SELECT series_id, greatest(d02, d12, d13, d03), least(d01, d23) FROM d UNION ALL SELECT series_id, greatest(d01, d13, d23, d02), least(d03, d12) FROM d)"""


@query(f"WITH {FOUR} SELECT series_id, round(birth, 6) + 0.0 AS birth, round(death, 6) + 0.0 AS death FROM rings WHERE birth < death")
def x2_four_points(spark, sf_dir):
    """Four points have a loop if one way round them is shorter, at its longest, than both ways across; a far class adds none."""
    v = F.col("values")
    four = F.array(*(F.slice(v, 16 * k + 1, 3) for k in range(4)))
    met = vector_series(spark, sf_dir).select("series_id", four.alias("points"), F.array(F.array(*[F.lit(1000.0)] * 3)).alias("class_points"))
    got = barcodes.slots(barcodes.cross_barcodes(met, ["series_id"], True), ["series_id"], (1,))
    return got.select("series_id", F.explode("bars").alias("b")).select("series_id", r6("b.birth").alias("birth"), r6("b.death").alias("death"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    test = sources.is_test(F.col("series_id"))
    return rows.where(~test), rows.where(test)


def _fitted(spark: SparkSession, sf_dir: str, config: class_features.Config = class_features.LITE):
    train, test = _split(vector_series(spark, sf_dir))
    model, found = class_features.fit(train, config, work_dir(spark))
    return train, test, model, found


@query()
def f8_training_features(spark, sf_dir):
    _, _, model, found = _fitted(spark, sf_dir)
    return features.wide(found, model.names)


@query()
def f8_full_features(spark, sf_dir):
    """All representations, loops included, at full sizes."""
    _, _, model, found = _fitted(spark, sf_dir, class_features.FULL)
    return features.wide(found, model.names)


@query()
def f9_unseen_features(spark, sf_dir):
    _, test, model, _ = _fitted(spark, sf_dir)
    return features.wide(class_features.transform(test, model, work=work_dir(spark)), model.names)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _split(experiments.vectors(vector_series(spark, sf_dir), ["statistics", "signature"]))


@query()
def e1_forest(spark, sf_dir):
    train, test = _vectors(spark, sf_dir)
    return evaluate.Classifier(evaluate.random_forest(50, 8)).fit(train).predict(test).select("series_id", "label", "prediction", "proba")


def _methods(spark: SparkSession) -> experiments.Methods:
    """Class-comparison features, fitted to the training series alone, and a generator that looks at one series."""

    def make(train: DataFrame, test: DataFrame, seed: int) -> dict[str, tuple[DataFrame, DataFrame]]:
        own = experiments.cloud_vectors(train, test, replace(class_features.QUICK, hom_dims=(0,), seed=seed), work_dir(spark))
        return {"classes": own, "signature": (experiments.vectors(train, ["signature"]), experiments.vectors(test, ["signature"]))}

    return make


@query()
def e4_cross_validation(spark, sf_dir):
    return experiments.cross_validation(vector_series(spark, sf_dir), _methods(spark), evaluate.random_forest(20, 6), 3, 1, work_dir(spark))


@query()
def e5_out_of_fold_classes(spark, sf_dir):
    """Out-of-fold probabilities of the class features, and the summary that follows: fused, stacked, boosted."""
    train, _ = _split(vector_series(spark, sf_dir))
    proba_ = experiments.out_of_fold(train, _methods(spark), evaluate.random_forest(20, 6), 2, 1, work_dir(spark))
    path = f"{work_dir(spark)}/proba"
    sinks.append_split(proba_.withColumn("dataset", F.lit("vectors")).withColumn("seed", F.lit(1)), path)
    rows = spark.read.parquet(path).drop("dataset", "seed")
    modules = ["classes", "signature"]
    out = experiments.fusion(rows, modules, ["series_id"])
    classes = [r[0] for r in train.select("label").distinct().orderBy("label").collect()]
    stacked = evaluate.stacking_matrix(rows, ["series_id", "label"], modules, classes)
    a, b = stacked.where("series_id % 2 = 0"), stacked.where("series_id % 2 = 1")
    for name, learner in (("logistic", evaluate.logistic(50)), ("boosted", evaluate.boosted(2, 3))):
        got = evaluate.stack(a, b, [f"p_{m}_{c}" for m in modules for c in classes], learner)
        out = out.unionByName(evaluate.accuracy(got).select(F.lit(name).alias("fusion"), "accuracy"))
    return out


def _out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(vector_series(spark, sf_dir))[0]
    out = None
    for name in ("statistics", "signature"):
        part = evaluate.out_of_fold(experiments.vectors(s, [name]), evaluate.random_forest(20, 6), name, 3, 1)
        out = part if out is None else out.unionByName(part)
    return out


@query()
def e5_out_of_fold(spark, sf_dir):
    return _out_of_fold(spark, sf_dir)


@query()
def e11_stacking(spark, sf_dir):
    table_ = evaluate.stacking_matrix(proba(spark, sf_dir), ["series_id", "label"], MODULES, list(range(10)))
    train, test = _split(table_)
    return evaluate.stack(train, test, [c for c in table_.columns if c.startswith("p_")], evaluate.logistic(100)).select("series_id", "label", "prediction")


@query()
def e11_boosted_stacking(spark, sf_dir):
    """The stack of three modules' probabilities, boosted over all ten classes at once (10 rounds)."""
    table_ = evaluate.stacking_matrix(proba(spark, sf_dir), ["series_id", "label"], MODULES, list(range(10)))
    train, test = _split(table_)
    return evaluate.stack(train, test, [c for c in table_.columns if c.startswith("p_")], evaluate.boosted_softmax(10)).select("series_id", "label", "prediction")


@query()
def e12_permutation_importance(spark, sf_dir):
    train, test = _split(experiments.vectors(vector_series(spark, sf_dir), ["signature"]))
    model = evaluate.Classifier(evaluate.random_forest(20, 6)).fit(train)
    return evaluate.permutation_importance(model, test, 6, 10)


@query()
def e13_impurity_importance(spark, sf_dir):
    train, _ = _split(experiments.vectors(vector_series(spark, sf_dir), ["signature"]))
    meta = spark.createDataFrame(list(enumerate(("s_t", "s_x", "s_tt", "s_tx", "s_xt", "s_xx"))), "position int, feature string")
    return evaluate.impurity_importance(evaluate.Classifier(evaluate.random_forest(20, 6)).fit(train), meta)


@query()
def e14_experiment_grid(spark, sf_dir):
    train, test = _split(vector_series(spark, sf_dir))

    def methods(a: DataFrame, b: DataFrame, seed: int) -> dict[str, tuple[DataFrame, DataFrame]]:
        return {n: (experiments.vectors(a, [n]), experiments.vectors(b, [n])) for n in ("statistics", "signature")}

    return experiments.grid({"vectors": (train, test)}, [0, 1], methods, trees=20, k=2, work=work_dir(spark))


@query()
def e14_class_grid(spark, sf_dir):
    train, test = _split(vector_series(spark, sf_dir))
    return experiments.grid({"vectors": (train, test)}, [0], _methods(spark), trees=20, k=2, work=work_dir(spark))


@query()
def e14_fusion_grid(spark, sf_dir):
    """Two combinations of modules over two seeds: weighted and stacked, from out-of-fold probabilities, scored on unseen series."""
    train, test = _split(vector_series(spark, sf_dir))

    def methods(a: DataFrame, b: DataFrame, seed: int) -> dict[str, tuple[DataFrame, DataFrame]]:
        return {n: (experiments.vectors(a, [n]), experiments.vectors(b, [n])) for n in ("statistics", "signature", "dynamics")}

    combos = {"statistics+signature": ["statistics", "signature"], "statistics+dynamics": ["statistics", "dynamics"]}
    return experiments.fusion_grid({"vectors": (train, test)}, [0, 1], methods, combos, work_dir(spark), {"LR": evaluate.logistic(20)}, trees=20, k=2)


@query()
def e14_fusion(spark, sf_dir):
    return experiments.fusion(proba(spark, sf_dir), MODULES, ["series_id"])


@query()
def i3_capped_components(spark, sf_dir):
    rows = independence.assign_folds(blocks(spark, sf_dir), 2)
    return independence.capped_pca(rows, "y", F.col("fold") != 0).select("row_id", F.posexplode("y").alias("slot", "value"))
