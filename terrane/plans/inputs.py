"""The graphs and fields that the registered queries take from the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import cut
from ..graph import Graph, from_edges
from ..operators.flow import steepest
from ..operators.fixpoint import roots
from ..sources import graphs

K = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_built: dict[tuple, tuple[DataFrame, Graph]] = {}


def _neighbourhoods(spark, sf_dir) -> tuple[DataFrame, Graph]:
    """The nearest neighbours and their graph, built once per session and state of the table and kept as written tables."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    key = sc.applicationId, sf_dir, store.getFileStatus(path).getModificationTime(), store.getContentSummary(path).getLength()
    if key not in _built:
        for old in [k for k in _built if k[:2] == key[:2] or k[0] != key[0]]:
            del _built[old]
        e = table(spark, sf_dir, "embeddings")
        found = cut(graphs.neighbours(e, K))
        _built[key] = found, from_edges(found.selectExpr("src as a", "dst as b", "len"), e.select(F.col("vec_id").cast("long").alias("v"))).cut()
    return _built[key]


def knn(spark, sf_dir) -> Graph:
    return _neighbourhoods(spark, sf_dir)[1]


def near(spark, sf_dir) -> DataFrame:
    """(src, dst, len): the K nearest others of each vector."""
    return _neighbourhoods(spark, sf_dir)[0]


def component(spark, sf_dir, k: int) -> DataFrame:
    return graphs.component_field(table(spark, sf_dir, "embeddings"), k)


def features(spark, sf_dir, ks) -> DataFrame:
    """(v, feature, value) of some vector components."""
    e = table(spark, sf_dir, "embeddings")
    pairs = F.array(*(F.struct(F.lit(f"f{k}").alias("feature"), F.col("embedding")[k].cast("double").alias("value")) for k in ks))
    return e.select(F.col("vec_id").alias("v"), F.explode(pairs).alias("p")).select("v", "p.feature", "p.value")


def orders_path(spark, sf_dir) -> Graph:
    """Each customer's orders by date, then key; lengths are the days between, at least 1."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = F.greatest(F.lit(1), F.datediff(F.col("__next.o_orderdate"), F.col("o_orderdate")))
    return graphs.path_graph(o, "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"], days)


def price(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("y"))


def residue(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), (F.col("o_orderkey") % 101).cast("double").alias("y"))


def labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "label")


def density(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), (1.0 + F.col("vec_id") % 5).alias("density"))


def mass(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), (1.0 + F.col("vec_id") % 3).alias("mass"))


def owners(graph: Graph, field: DataFrame) -> DataFrame:
    """(v, direction, extremum): the ends of each vertex's steepest walks."""
    up = roots(steepest(graph, field, True)).select("v", F.lit("max").alias("direction"), F.col("root").alias("extremum"))
    return up.union(roots(steepest(graph, field, False)).select("v", F.lit("min"), "root"))


def spread(graph: Graph, own: DataFrame) -> DataFrame:
    """Overlapping membership: a vertex is in the basins of its own ends and of its neighbours'."""
    near = graph.edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).join(own.withColumnRenamed("v", "u"), "u").select("v", "direction", "extremum")
    return own.union(near).distinct()


SQL_KNN = f"""
vec AS MATERIALIZED (SELECT vec_id AS v, embedding::DOUBLE[] AS e FROM embeddings),
near AS MATERIALIZED (
  SELECT a.v AS src, b.v AS dst, list_distance(a.e, b.e) AS len FROM vec a JOIN vec b ON a.v <> b.v
  QUALIFY row_number() OVER (PARTITION BY a.v ORDER BY list_distance(a.e, b.e), b.v) <= {K}
),
edges AS MATERIALIZED (SELECT src, dst, min(len) AS len FROM (SELECT * FROM near UNION ALL SELECT dst, src, len FROM near) GROUP BY src, dst),
vertices AS (SELECT v FROM vec),
fy AS (SELECT v, e[1] AS y FROM vec),
fz AS (SELECT v, e[2] AS y FROM vec)"""

SQL_PATH = """
steps AS MATERIALIZED (
  SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, greatest(1, datediff('day', o_orderdate::DATE, lead(o_orderdate::DATE) OVER w))::DOUBLE AS len
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, len FROM steps WHERE b IS NOT NULL UNION ALL SELECT b, a, len FROM steps WHERE b IS NOT NULL),
vertices AS (SELECT o_orderkey AS v FROM orders),
fy AS (SELECT o_orderkey AS v, o_totalprice AS y FROM orders),
fz AS (SELECT o_orderkey AS v, (o_orderkey % 101)::DOUBLE AS y FROM orders)"""

#: Directed edges with both fields at both ends.
SQL_EDGES = """
ev AS MATERIALIZED (
  SELECT e.src, e.dst, e.len, a.y AS ys, b.y AS yd, c.y AS zs, d.y AS zd
  FROM edges e JOIN fy a ON a.v = e.src JOIN fy b ON b.v = e.dst JOIN fz c ON c.v = e.src JOIN fz d ON d.v = e.dst
)"""


def sql_owners(f: str, name: str) -> str:
    """Ends of steepest walks of a field, both directions; needs WITH RECURSIVE."""
    out = []
    for d, better, order in (("max", "b.y > a.y", "b.y DESC"), ("min", "b.y < a.y", "b.y ASC")):
        out.append(f"""
{name}_{d}_next AS MATERIALIZED (
  SELECT e.src, e.dst FROM edges e JOIN {f} a ON a.v = e.src JOIN {f} b ON b.v = e.dst WHERE {better}
  QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY {order}, e.dst) = 1
),
{name}_{d}_walk(v, pt) AS (SELECT v, v FROM vertices UNION ALL SELECT w.v, n.dst FROM {name}_{d}_walk w JOIN {name}_{d}_next n ON n.src = w.pt),
{name}_{d} AS MATERIALIZED (SELECT w.v, w.pt AS extremum FROM {name}_{d}_walk w ANTI JOIN {name}_{d}_next n ON n.src = w.pt)""")
    out.append(f"""
{name} AS MATERIALIZED (SELECT v, 'max' AS direction, extremum FROM {name}_max UNION ALL SELECT v, 'min', extremum FROM {name}_min)""")
    return ",".join(out)


SQL_SPREAD = """
spread AS MATERIALIZED (SELECT * FROM own UNION SELECT e.src, o.direction, o.extremum FROM edges e JOIN own o ON o.v = e.dst)"""
