"""Registered queries and, where SQL can say the same, their SQL. Doubles are rounded, as sums differ in their last bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import models, scalars, stats
from ..graph import degrees, from_edges
from ..operators import association as A, basins as B, charts, clusters, comparison as C, extrema as X, flow as W, grid as G, merge_tree as M, nerve as N, paths as P, pruning, spectrum
from ..operators.fixpoint import hops, roots
from ..operators.tolerant import tolerant_basins
from ..sources import graphs
from . import inputs as I
from .basin_complex import basin_complex

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(c: str, places: int = 9) -> str:
    return f"round({c}, {places}) + 0.0"


def _knn(tail: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{I.SQL_KNN},{I.SQL_EDGES}{more}\n{tail}"


def _path(tail: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{I.SQL_PATH},{I.SQL_EDGES}{more}\n{tail}"


def _fields(spark, sf_dir):
    return I.component(spark, sf_dir, 0), I.component(spark, sf_dir, 1)


def _sp(starts: str, where: str = "true", name: str = "sp", edges: str = "edges") -> str:
    """Shortest distances from starts (v): name(ref, v, dist)."""
    return f""",
{name}(ref, v, dist) USING KEY (ref, v) AS (SELECT v, v, 0.0::DOUBLE FROM {starts} UNION SELECT s.ref, e.dst, min(s.dist + e.len) FROM {name} s JOIN {edges} e ON e.src = s.v
  LEFT JOIN recurring.{name} r ON r.ref = s.ref AND r.v = e.dst WHERE (r.dist IS NULL OR s.dist + e.len < r.dist) AND {where} GROUP BY s.ref, e.dst)"""


def _bfs(starts: str, name: str = "lv", edges: str = "edges") -> str:
    """Hops from starts (v): name(ref, v, hop)."""
    return f""",
{name}(ref, v, hop) USING KEY (ref, v) AS (SELECT v, v, 0 FROM {starts} UNION SELECT l.ref, e.dst, min(l.hop + 1) FROM {name} l JOIN {edges} e ON e.src = l.v
  LEFT JOIN recurring.{name} r ON r.ref = l.ref AND r.v = e.dst WHERE r.hop IS NULL GROUP BY l.ref, e.dst)"""


# Graphs


@_register(_knn(f"SELECT src, dst, {_r('len')} AS len FROM edges"))
def knn_graph(spark, sf_dir):
    return _rounded(graphs.knn_graph(I.table(spark, sf_dir, "embeddings"), I.K).edges)


@_register(_path("SELECT src, dst, len FROM edges"))
def path_graph(spark, sf_dir):
    return I.orders_path(spark, sf_dir).edges


@_register(
    "WITH p AS (SELECT l_partkey AS a, l_suppkey + 1000000000 AS b, 1.0::DOUBLE / count(*) AS len FROM lineitem GROUP BY ALL) "
    "SELECT a AS src, b AS dst, round(len, 9) + 0.0 AS len FROM p UNION ALL SELECT b, a, round(len, 9) + 0.0 FROM p"
)
def bipartite_graph(spark, sf_dir):
    return _rounded(graphs.bipartite_graph(I.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 1_000_000_000).edges)


@_register(
    _path(
        f"SELECT v, coalesce(d, 0)::BIGINT AS degree, {_r('m')} AS mean_len, {_r('l')} AS min_len FROM vertices LEFT JOIN (SELECT src, count(*) AS d, avg(len) AS m, min(len) AS l FROM edges GROUP BY src) ON src = v"
    )
)
def graph_degrees(spark, sf_dir):
    return _rounded(degrees(I.orders_path(spark, sf_dir)))


@_register(_knn(f"SELECT {_r('quantile_cont(len, 0.9)')} AS threshold FROM edges WHERE src < dst"))
def edge_length_quantile(spark, sf_dir):
    return _rounded(X.edge_length_quantile(I.knn(spark, sf_dir), 0.9))


def _quantised(spark, sf_dir):
    return I.component(spark, sf_dir, 0).select("v", F.round("y", 1).alias("y"))


@_register(
    _knn(
        "SELECT a AS v, min(b) AS component, count(*)::BIGINT AS size FROM reach GROUP BY a",
        ",\nlinks AS MATERIALIZED (SELECT src, dst FROM ev WHERE round(ys, 1) = round(yd, 1)),\nreach(a, b) AS (SELECT v, v FROM vertices UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b)",
        True,
    )
)
def plateau_components(spark, sf_dir):
    p = W.plateaus(I.knn(spark, sf_dir), _quantised(spark, sf_dir))
    size = p.groupBy("plateau").agg(F.count("*").alias("size"))
    return p.join(size, "plateau").select("v", F.col("plateau").alias("component"), "size")


# Local correlation and slope

_LCOR = """SELECT v, coalesce(CASE WHEN a > 1e-10 AND b > 1e-10 THEN round(greatest(-1.0, least(1.0, n / (a * b))), 9) + 0.0 END, 0.0) AS lcor FROM vertices LEFT JOIN (
  SELECT src, sum(w * dy * dz) AS n, sqrt(sum(w * dy * dy)) AS a, sqrt(sum(w * dz * dz)) AS b FROM d GROUP BY src) ON src = v"""


def _d(dy: str, dz: str, w: str, where: str = "", source: str = "ev") -> str:
    return f",\nd AS MATERIALIZED (SELECT src, dst, {dy} AS dy, {dz} AS dz, {w} AS w FROM {source} {where})"


_PLAIN = ("yd - ys", "zd - zs", "1 / (len * len)", "WHERE len > 1e-10")


def flagship(spark, sf_dir):
    """Local correlation of two vector components over the graph of nearest neighbours."""
    y, z = _fields(spark, sf_dir)
    return _rounded(A.lcor(graphs.knn_graph(I.table(spark, sf_dir, "embeddings"), I.K), y, z))


@_register(_knn(_LCOR, _d(*_PLAIN)))
def lcor_derivative(spark, sf_dir):
    return flagship(spark, sf_dir)


@_register(_path(_LCOR, _d("yd - ys", "zd - zs", "1.0")))
def lcor_unit(spark, sf_dir):
    return _rounded(A.lcor(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), I.residue(spark, sf_dir), kind="unit"))


@_register(
    _path(
        _LCOR,
        ",\neps AS (SELECT (SELECT min(y) * 1e-6 FROM fy WHERE y > 0) AS ey, (SELECT min(y) * 1e-6 FROM fz WHERE y > 0) AS ez)" + _d("ln((yd + ey) / (ys + ey))", "ln((zd + ez) / (zs + ez))", "1 / (len * len)", "WHERE len > 1e-10", "ev, eps"),
    )
)
def lcor_logratio(spark, sf_dir):
    return _rounded(A.lcor(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), I.residue(spark, sf_dir), y_diff="logratio", z_diff="logratio"))


_BOUNDS = """,
srt AS (SELECT list(dy ORDER BY dy) AS ys, list(dz ORDER BY dz) AS zs, count(*) AS n FROM d0),
lim AS (SELECT ys[1 + floor(n * 0.05)::INT] AS yl, ys[ceil(n * 0.95)::INT] AS yh, zs[1 + floor(n * 0.05)::INT] AS zl, zs[ceil(n * 0.95)::INT] AS zh FROM srt),
d AS MATERIALIZED (SELECT src, dst, least(greatest(dy, yl), yh) AS dy, least(greatest(dz, zl), zh) AS dz, w FROM d0, lim)"""


@_register(_knn(_LCOR, _d(*_PLAIN).replace("d AS", "d0 AS", 1) + _BOUNDS))
def lcor_winsorized(spark, sf_dir):
    return _rounded(A.lcor(I.knn(spark, sf_dir), *_fields(spark, sf_dir), winsor=0.05))


@_register(
    _knn(
        _LCOR,
        """,
e2 AS MATERIALIZED (SELECT src, dst, min(len) AS len FROM (SELECT * FROM edges UNION ALL SELECT a.src, b.dst, a.len + b.len FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY src, dst),
ev2 AS MATERIALIZED (SELECT e.src, e.dst, e.len, a.y AS ys, b.y AS yd, c.y AS zs, d.y AS zd FROM e2 e JOIN fy a ON a.v = e.src JOIN fy b ON b.v = e.dst JOIN fz c ON c.v = e.src JOIN fz d ON d.v = e.dst)"""
        + _d(*_PLAIN, "ev2"),
    )
)
def lcor_two_hops(spark, sf_dir):
    return _rounded(A.lcor(I.knn(spark, sf_dir), *_fields(spark, sf_dir), hop_radius=2))


@_register(_knn(f"SELECT src, dst, {_r('dy')} AS dy, {_r('dz')} AS dz, {_r('w')} AS w FROM d", _d(*_PLAIN)))
def lcor_edges(spark, sf_dir):
    y, z = _fields(spark, sf_dir)
    return _rounded(A.lcor_matrix(I.knn(spark, sf_dir), y, A.one_feature(z), edges=True).drop("feature"))


_MANY = """,
ks AS (SELECT unnest([2, 3, 4, 5]) AS k),
d AS MATERIALIZED (SELECT e.src, e.dst, k, b.e[1] - a.e[1] AS dy, b.e[k] - a.e[k] AS dz, 1 / (len * len) AS w FROM edges e JOIN vec a ON a.v = e.src JOIN vec b ON b.v = e.dst, ks WHERE len > 1e-10)"""
_BY_FEATURE = """SELECT src AS v, 'f' || (k - 1) AS feature, CASE WHEN sqrt(sum(w * dy * dy)) > 1e-10 AND sqrt(sum(w * dz * dz)) > 1e-10
  THEN round(greatest(-1.0, least(1.0, sum(w * dy * dz) / (sqrt(sum(w * dy * dy)) * sqrt(sum(w * dz * dz))))), 9) + 0.0 ELSE 0.0 END AS lcor FROM d GROUP BY src, k"""


@_register(_knn(_BY_FEATURE, _MANY))
def lcor_vector_matrix(spark, sf_dir):
    return _rounded(A.lcor_matrix(I.knn(spark, sf_dir), _fields(spark, sf_dir)[0], I.features(spark, sf_dir, range(1, 5))))


@_register(
    _knn(
        """SELECT src AS v, 'f' || p AS a, 'f' || q AS b, CASE WHEN sqrt(sum(w * x * x)) > 1e-10 AND sqrt(sum(w * y * y)) > 1e-10
  THEN round(greatest(-1.0, least(1.0, sum(w * x * y) / (sqrt(sum(w * x * x)) * sqrt(sum(w * y * y))))), 9) + 0.0 ELSE 0.0 END AS lcor FROM d GROUP BY src, p, q""",
        """,
ks AS (SELECT unnest([0, 1, 2, 3]) AS k),
d AS MATERIALIZED (SELECT e.src, i.k AS p, j.k AS q, b.e[i.k + 1] - a.e[i.k + 1] AS x, b.e[j.k + 1] - a.e[j.k + 1] AS y, 1 / (len * len) AS w
  FROM edges e JOIN vec a ON a.v = e.src JOIN vec b ON b.v = e.dst, ks i, ks j WHERE len > 1e-10 AND i.k < j.k)""",
    )
)
def lcor_matrix_matrix(spark, sf_dir):
    return _rounded(A.lcor_pairs(I.knn(spark, sf_dir), I.features(spark, sf_dir, range(4))))


_POSTERIOR = _BY_FEATURE.replace("SELECT src AS v, 'f' || (k - 1) AS feature,", "SELECT src AS v, k,")


@_register(
    _knn(
        f"SELECT v, {_r('avg(lcor)', 8)} AS mean, {_r('stddev_samp(lcor)', 8)} AS sd, {_r('quantile_cont(lcor, 0.05)', 8)} AS low, {_r('quantile_cont(lcor, 0.95)', 8)} AS high FROM draws GROUP BY v",
        _MANY.replace("[2, 3, 4, 5]", "range(2, 12)") + f",\ndraws AS ({_POSTERIOR.replace('round(greatest', '(greatest').replace(', 9) + 0.0', ')')})",
    )
)
def lcor_posterior(spark, sf_dir):
    draws = I.features(spark, sf_dir, range(1, 11)).select("v", F.lit("z").alias("feature"), F.col("feature").alias("draw"), "value")
    return _rounded(A.lcor_posterior(I.knn(spark, sf_dir), _fields(spark, sf_dir)[0], draws, 0.9).drop("feature"), 8)


@_register()
def permutation_test(spark, sf_dir):
    return _rounded(A.permutation_test(I.knn(spark, sf_dir), _fields(spark, sf_dir)[0], I.features(spark, sf_dir, range(1, 4)), times=49))


_BEST = """,
best AS MATERIALIZED (SELECT * FROM ev WHERE yd > ys QUALIFY row_number() OVER (PARTITION BY src ORDER BY yd - ys DESC, dst) = 1)"""


@_register(
    _knn(
        f"SELECT v, coalesce({_r('(zd - zs) / (yd - ys)', 7)}, 0.0) AS slope, dst AS neighbour, coalesce({_r('yd - ys')}, 0.0) AS dy, coalesce({_r('zd - zs')}, 0.0) AS dz, dst IS NULL AS is_extremum FROM vertices LEFT JOIN best ON src = v", _BEST
    )
)
def lslope(spark, sf_dir):
    out = A.lslope(I.knn(spark, sf_dir), *_fields(spark, sf_dir)).withColumn("slope", F.round("slope", 7))
    return _rounded(out)


@_register(_path("SELECT v, coalesce(sign(zd - zs), 0)::DOUBLE AS slope FROM vertices LEFT JOIN best ON src = v", _BEST))
def lslope_sign(spark, sf_dir):
    return A.lslope(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), I.residue(spark, sf_dir), "sign").select("v", "slope")


@_register(
    _knn(
        f"SELECT v, coalesce({_r('tanh(0.5493061443340549 / med * (zd - zs) / (yd - ys))', 8)}, 0.0) AS slope FROM vertices LEFT JOIN best ON src = v, (SELECT median(abs((zd - zs) / (yd - ys))) AS med FROM best)", _BEST
    )
)
def lslope_normalized(spark, sf_dir):
    return _rounded(A.lslope(I.knn(spark, sf_dir), *_fields(spark, sf_dir), "normalized").select("v", "slope"), 8)


@_register(
    _knn(
        f"""SELECT v, {_r('coalesce(n / yy, 0.0)')} AS slope, {_r('coalesce(sqrt(yy), 0.0)')} AS sd_y, {_r('coalesce(sqrt(zz), 0.0)')} AS sd_z, {_r('coalesce(greatest(-1.0, least(1.0, n / (sqrt(yy) * sqrt(zz)))), 0.0)')} AS lcor
FROM vertices LEFT JOIN (SELECT src, sum(w * dy * dz) AS n, sum(w * dy * dy) AS yy, sum(w * dz * dz) AS zz FROM d GROUP BY src) ON src = v""",
        _d(*_PLAIN),
    )
)
def neighbourhood_slope(spark, sf_dir):
    return _rounded(A.neighbourhood_slope(I.knn(spark, sf_dir), *_fields(spark, sf_dir)))


@_register(
    _path("SELECT count(*) FILTER ((yd - ys) * (zd - zs) > 0) AS concordant, count(*) FILTER ((yd - ys) * (zd - zs) < 0) AS discordant, count(*) FILTER ((yd - ys) * (zd - zs) = 0) AS tied FROM ev WHERE src < dst")
)
def edge_concordance(spark, sf_dir):
    return A.edge_concordance(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), I.residue(spark, sf_dir))


# Extrema

_NEAR = ",\nnb AS MATERIALIZED (SELECT src, min(yd) AS lo, max(yd) AS hi FROM ev GROUP BY src)"
_EXT = _NEAR + ",\next AS MATERIALIZED (SELECT f.v, CASE WHEN hi < y THEN 'max' ELSE 'min' END AS type, y FROM fy f JOIN nb ON src = f.v WHERE hi < y OR lo > y)"


@_register(_path("SELECT f.v, y, coalesce(lo > y, true) AS is_min, coalesce(hi < y, false) AS is_max FROM fy f LEFT JOIN nb ON src = f.v", _NEAR))
def strict_extrema(spark, sf_dir):
    return X.strict_extrema(I.orders_path(spark, sf_dir), I.price(spark, sf_dir))


@_register(
    _path("SELECT v, type, y, CASE type WHEN 'max' THEN 'M' ELSE 'm' END || row_number() OVER (PARTITION BY type ORDER BY CASE type WHEN 'max' THEN -y ELSE y END, v) AS label FROM ext", _EXT)
)
def extrema_labels(spark, sf_dir):
    return X.relabel(X.extrema_table(I.orders_path(spark, sf_dir), I.price(spark, sf_dir)))


@_register(
    _knn(
        "SELECT f.v, 'max' AS type, round(y, 1) + 0.0 AS y, 1::BIGINT AS n_basin FROM fy f JOIN q ON q.src = f.v WHERE hi <= round(y, 1) UNION ALL SELECT f.v, 'min', round(y, 1) + 0.0, 1 FROM fy f JOIN q ON q.src = f.v WHERE lo >= round(y, 1)",
        ",\nq AS (SELECT src, min(round(yd, 1)) AS lo, max(round(yd, 1)) AS hi FROM ev GROUP BY src)",
    )
)
def local_extrema(spark, sf_dir):
    return _rounded(X.local_extrema(I.knn(spark, sf_dir), _quantised(spark, sf_dir)))


@_register(
    _knn(
        """SELECT ref AS v, type, round(own, 9) + 0.0 AS y, count(*) AS n_basin FROM (SELECT n.ref, w.type, w.own, CASE w.type WHEN 'max' THEN f.y > w.own ELSE f.y < w.own END AS bad
  FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY ref ORDER BY dist, v) <= 6) n JOIN weak w ON w.v = n.ref JOIN fy f ON f.v = n.v) GROUP BY ALL HAVING count(*) = 6 AND NOT bool_or(bad)""".replace("GROUP BY ALL", "GROUP BY ref, type, own"),
        _NEAR + ",\nweak AS MATERIALIZED (SELECT f.v, 'max' AS type, y AS own FROM fy f JOIN nb ON src = f.v WHERE hi <= y UNION ALL SELECT f.v, 'min', y FROM fy f JOIN nb ON src = f.v WHERE lo >= y)" + _sp("(SELECT DISTINCT v FROM weak)"),
        True,
    )
)
def local_extrema_sized(spark, sf_dir):
    return _rounded(X.local_extrema(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), 6))


@_register(
    _knn(
        """SELECT ref AS v, round(own, 9) + 0.0 AS y, round(max(dist), 9) + 0.0 AS radius, count(*) AS size FROM (
  SELECT s.ref, s.dist, a.y AS own, sum(CASE WHEN b.y >= a.y THEN 1 ELSE 0 END) OVER (PARTITION BY s.ref ORDER BY s.dist, s.v) AS failed FROM sp s JOIN fy a ON a.v = s.ref JOIN fy b ON b.v = s.v WHERE s.v <> s.ref)
WHERE failed = 0 GROUP BY ref, own HAVING count(*) >= 4""",
        _sp("vertices", "s.dist + e.len <= 12"),
        True,
    )
)
def radius_extrema(spark, sf_dir):
    return _rounded(X.radius_extrema(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), 12.0, 4))


@_register(
    _knn(
        f"SELECT v, {_r('hi')} AS maxp, {_r('lo')} AS minp FROM vertices LEFT JOIN (SELECT src, sum(CASE WHEN yd < ys THEN 1 + dst % 5 ELSE 0 END)::DOUBLE / sum(1 + dst % 5) AS hi, sum(CASE WHEN yd > ys THEN 1 + dst % 5 ELSE 0 END)::DOUBLE / sum(1 + dst % 5) AS lo FROM ev GROUP BY src) ON src = v"
    )
)
def neighbour_share(spark, sf_dir):
    return _rounded(X.neighbour_share(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), I.density(spark, sf_dir)))


_HOPS = (
    _EXT
    + _bfs("ext")
    + """,
idx AS MATERIALIZED (SELECT x.v, x.type, x.y, min(h.hop) AS hop_idx FROM ext x LEFT JOIN (SELECT l.ref, l.hop, f.y, e.type, e.y AS own FROM lv l JOIN fy f ON f.v = l.v JOIN ext e ON e.v = l.ref
  WHERE l.hop > 0 AND ((e.type = 'max' AND f.y >= e.y) OR (e.type = 'min' AND f.y <= e.y))) h ON h.ref = x.v GROUP BY ALL)"""
)


def _indexed(spark, sf_dir):
    g, y = I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)
    return X.hop_index(g, y, X.extrema_table(g, y))


@_register(_knn(f"SELECT v, type, {_r('y')} AS y, hop_idx::INT AS hop_idx FROM idx", _HOPS, True))
def hop_index(spark, sf_dir):
    return _rounded(_indexed(spark, sf_dir))


@_register(
    _knn(
        "SELECT l.ref, l.v, min(l.hop)::INT AS hop, min(l.hop) = any_value(i.hop_idx) AS boundary FROM lv l JOIN idx i ON i.v = l.ref WHERE i.hop_idx IS NOT NULL GROUP BY l.ref, l.v HAVING min(l.hop) <= any_value(i.hop_idx)", _HOPS, True
    )
)
def hop_neighbourhoods(spark, sf_dir):
    return X.hop_neighbourhoods(I.knn(spark, sf_dir), _indexed(spark, sf_dir))


def _spurious(rule: str) -> str:
    return _knn(
        f"SELECT v, coalesce({rule} AND n > 1, false) AS spurious FROM idx, (SELECT quantile_cont(hop_idx, 0.25) AS q1, quantile_cont(hop_idx, 0.75) AS q3, count(*) AS n FROM idx)", _HOPS, True
    )


for _name, _rule in {"threshold": "hop_idx <= 2", "quantile": "hop_idx <= q1", "outlier": "hop_idx < q1 - 1.5 * (q3 - q1)", "combined": "(hop_idx <= 2 AND hop_idx <= q1)"}.items():

    def _classified(spark, sf_dir, name=_name):
        return X.classify_spurious(_indexed(spark, sf_dir), name).select("v", "spurious")

    _classified.__name__ = f"spurious_{_name}"
    _register(_spurious(_rule))(_classified)


@_register(
    _knn(
        "SELECT threshold::INT AS threshold, count(*) FILTER (type = 'max') AS n_max, count(*) FILTER (type = 'min') AS n_min FROM idx, (SELECT unnest([1, 2, 3, 4]) AS threshold) WHERE hop_idx IS NULL OR hop_idx > threshold GROUP BY threshold", _HOPS, True
    )
)
def retained_by_threshold(spark, sf_dir):
    return X.retained_by_threshold(_indexed(spark, sf_dir), [1, 2, 3, 4]).drop("values")


@_register(
    _knn(
        "SELECT threshold::INT AS threshold, retained, off, row_number() OVER (ORDER BY off, threshold) = 1 AS best FROM (SELECT threshold, count(*) FILTER (hop_idx > threshold) AS retained, abs(count(*) FILTER (hop_idx > threshold) - 10) AS off FROM idx, (SELECT unnest(range(0, 11)) AS threshold) WHERE hop_idx IS NOT NULL GROUP BY threshold)",
        _HOPS,
        True,
    )
)
def suggest_threshold(spark, sf_dir):
    return X.suggest_threshold(_indexed(spark, sf_dir), 10)


@_register(
    _knn(
        f"SELECT hop_idx::INT AS hop_idx, n, {_r('sum(n) OVER (ORDER BY hop_idx) / sum(n) OVER ()')} AS share_at_most, (hop_idx - lag(hop_idx) OVER (ORDER BY hop_idx))::INT AS gap FROM (SELECT hop_idx, count(*) AS n FROM idx WHERE hop_idx IS NOT NULL GROUP BY hop_idx)",
        _HOPS,
        True,
    )
)
def index_distribution(spark, sf_dir):
    return _rounded(X.index_distribution(_indexed(spark, sf_dir)))


@_register(
    _knn(
        f"""SELECT x.v, {_r('x.y')} AS y, CASE WHEN x.y <> (SELECT max(y) FROM fy) THEN coalesce(min(s.hop) FILTER (NOT s.ok) - 1, max(s.hop) + 1, 0) END::INT AS hop_radius FROM top x LEFT JOIN share s ON s.ref = x.v GROUP BY x.v, x.y""",
        _EXT
        + ",\ntop AS MATERIALIZED (SELECT v, y FROM ext WHERE type = 'max')"
        + _bfs("top")
        + """,
ring AS (SELECT l.ref, l.hop, sum(1 + l.v % 5) AS t, sum(CASE WHEN f.y < x.y THEN 1 + l.v % 5 ELSE 0 END) AS s FROM lv l JOIN fy f ON f.v = l.v JOIN top x ON x.v = l.ref WHERE l.hop > 0 GROUP BY ALL),
share AS MATERIALIZED (SELECT ref, hop, (sum(s) OVER w)::DOUBLE / sum(t) OVER w >= 0.8 AS ok FROM ring WINDOW w AS (PARTITION BY ref ORDER BY hop))""",
        True,
    )
)
def probable_radius(spark, sf_dir):
    return _rounded(X.probable_radius(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), I.density(spark, sf_dir), 0.8))


# Flow

_LIMIT = ",\nlim AS (SELECT quantile_cont(len, 0.9) AS q FROM edges WHERE src < dst)"


def _next_sql(gain: str, order: str, more: str = "", where: str = "AND len <= q") -> str:
    return f"""SELECT v, dst AS next FROM vertices LEFT JOIN (
  SELECT src, dst FROM ev{more}, lim WHERE {gain} > 0 {where} QUALIFY row_number() OVER (PARTITION BY src ORDER BY {order}, dst) = 1) ON src = v"""


@_register(_knn("SELECT v, dst AS next, round(len, 9) + 0.0 AS len, coalesce(lf, false) AS long_edge FROM vertices LEFT JOIN (SELECT src, dst, len, len > q AS lf FROM ev, lim WHERE yd > ys QUALIFY row_number() OVER (PARTITION BY src ORDER BY len > q, len, dst) = 1) ON src = v", _LIMIT))
def next_vertex_closest(spark, sf_dir):
    return _rounded(W.next_vertex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)))


@_register(_path(_next_sql("ys - yd", "ys - yd DESC"), _LIMIT))
def next_vertex_gain(spark, sf_dir):
    return W.next_vertex(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), False, "none").select("v", "next")


_DENSITY = ",\nrho AS (SELECT src AS u, (1 / min(len)) / max(1 / min(len)) OVER () AS r FROM edges GROUP BY src)"


@_register(_knn(_next_sql("(yd - ys)", "(yd - ys) * r DESC", " JOIN rho ON u = dst"), _LIMIT + _DENSITY))
def next_vertex_density(spark, sf_dir):
    return W.next_vertex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), True, "density").select("v", "next")


_KDE = """,
und AS MATERIALIZED (SELECT src AS s, dst AS t, len FROM edges WHERE src < dst),
bw AS (SELECT 1.06 * stddev_samp(len) * pow(count(*), -0.2) AS h FROM und),
kd AS MATERIALIZED (SELECT a.s, a.t, sum(exp(-0.5 * pow((a.len - b.len) / h, 2))) AS d FROM und a, und b, bw GROUP BY a.s, a.t),
kw AS MATERIALIZED (SELECT s, t, d / max(d) OVER () AS w FROM kd)"""


@_register(_knn(f"SELECT s AS src, t AS dst, {_r('w', 7)} AS w FROM kw", _KDE))
def length_weights(spark, sf_dir):
    return _rounded(W.length_weight(I.knn(spark, sf_dir)).filter("src < dst"), 7)


@_register(_knn(_next_sql("(yd - ys)", "(yd - ys) * w DESC", " JOIN kw ON s = least(src, dst) AND t = greatest(src, dst)"), _LIMIT + _KDE))
def next_vertex_edgelen(spark, sf_dir):
    return W.next_vertex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), True, "edgelen").select("v", "next")


@_register(_knn(_next_sql("(yd - ys)", "(yd - ys) * r * w DESC", " JOIN rho ON u = dst JOIN kw ON s = least(src, dst) AND t = greatest(src, dst)"), _LIMIT + _DENSITY + _KDE))
def next_vertex_density_edgelen(spark, sf_dir):
    return W.next_vertex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), True, "density_edgelen").select("v", "next")


_OWN = f",{I.sql_owners('fy', 'own')}"


@_register(_path("SELECT v, extremum AS root, (SELECT count(*) FROM own_max_walk w WHERE w.v = own_max.v) - 1 AS steps FROM own_max", _OWN, True))
def flow_basins(spark, sf_dir):
    return roots(W.steepest(I.orders_path(spark, sf_dir), I.price(spark, sf_dir)))


@_register(_path("SELECT v AS seed, list(pt ORDER BY y) AS path FROM (SELECT w.v, w.pt, f.y FROM own_max_walk w JOIN fy f ON f.v = w.pt) GROUP BY v", _OWN, True).replace("list(pt ORDER BY y) AS path", "array_to_string(list(pt ORDER BY y), ',') AS path"))
def ascending_paths(spark, sf_dir):
    g, y = I.orders_path(spark, sf_dir), I.price(spark, sf_dir)
    return W.trajectories(W.steepest(g, y), g.vertices).select("seed", F.concat_ws(",", "path").alias("path"))


@_register(
    _knn(
        "SELECT p.v, p.plateau, CASE WHEN p.v = coalesce(t.source, p.plateau) THEN t.target ELSE (SELECT min(i.dst) FROM inside i JOIN lv o ON o.ref = l.ref AND o.v = i.dst WHERE i.src = p.v AND o.hop = l.hop - 1) END AS next, w.pt AS root "
        "FROM pl p JOIN tops t USING (plateau) JOIN lv l ON l.ref = coalesce(t.source, p.plateau) AND l.v = p.v JOIN pw w ON w.plateau = p.plateau ANTI JOIN (SELECT plateau AS pt FROM tops WHERE going IS NOT NULL) g ON g.pt = w.pt",
        _LIMIT
        + """,
qe AS MATERIALIZED (SELECT src, dst, len, round(ys, 1) AS a, round(yd, 1) AS b FROM ev),
inside AS MATERIALIZED (SELECT src, dst FROM qe WHERE a = b),
reach(a, b) AS (SELECT v, v FROM vertices UNION SELECT r.a, l.dst FROM reach r JOIN inside l ON l.src = r.b),
pl AS MATERIALIZED (SELECT a AS v, min(b) AS plateau FROM reach GROUP BY a),
best AS MATERIALIZED (SELECT s.plateau, src AS source, dst AS target, d.plateau AS going FROM qe JOIN pl s ON s.v = src JOIN pl d ON d.v = dst, lim WHERE b > a QUALIFY row_number() OVER (PARTITION BY s.plateau ORDER BY len > q, len, dst, src) = 1),
tops AS MATERIALIZED (SELECT p.plateau, source, target, going FROM (SELECT DISTINCT plateau FROM pl) p LEFT JOIN best USING (plateau)),
pw(plateau, pt) AS (SELECT plateau, plateau FROM tops UNION ALL SELECT w.plateau, t.going FROM pw w JOIN tops t ON t.plateau = w.pt WHERE t.going IS NOT NULL)"""
        + _bfs("(SELECT coalesce(source, plateau) AS v FROM tops)", edges="inside"),
        True,
    )
)
def plateau_flow(spark, sf_dir):
    return W.plateau_flow(I.knn(spark, sf_dir), _quantised(spark, sf_dir))[0]


def _walk_sql(name: str, better: str) -> str:
    """Walks by the shortest improving edge: name_next(src, dst), name_walk(v, pt, k), name_end(v, pt)."""
    return f""",
{name}_next AS MATERIALIZED (SELECT src, dst FROM ev, lim WHERE {better} QUALIFY row_number() OVER (PARTITION BY src ORDER BY len > q, len, dst) = 1),
{name}_walk(v, pt, k) AS (SELECT v, v, 0 FROM vertices UNION ALL SELECT w.v, n.dst, w.k + 1 FROM {name}_walk w JOIN {name}_next n ON n.src = w.pt),
{name}_end AS MATERIALIZED (SELECT w.v, w.pt FROM {name}_walk w ANTI JOIN {name}_next n ON n.src = w.pt)"""


_TRAJECTORIES = (
    _EXT
    + _LIMIT
    + _walk_sql("up", "yd > ys")
    + _walk_sql("dn", "yd < ys")
    + """,
ends AS MATERIALIZED (SELECT u.v, d.pt AS mn, u.pt AS mx FROM up_end u JOIN dn_end d USING (v) JOIN ext a ON a.v = u.pt AND a.type = 'max' JOIN ext b ON b.v = d.pt AND b.type = 'min'),
covered AS MATERIALIZED (SELECT DISTINCT pt FROM up_walk JOIN ends USING (v) WHERE v = mn UNION SELECT DISTINCT pt FROM dn_walk JOIN ends USING (v) WHERE v = mx),
open_ AS MATERIALIZED (SELECT v FROM ends ANTI JOIN covered ON pt = v),
joins AS MATERIALIZED (SELECT v FROM open_ ANTI JOIN (SELECT w.pt FROM up_walk w JOIN open_ o ON o.v = w.v WHERE w.k > 0) x ON x.pt = open_.v),
seeds AS MATERIALIZED (SELECT v FROM ends WHERE v = mn OR v = mx UNION SELECT v FROM joins),
onpath AS MATERIALIZED (SELECT w.v, w.pt, w.k FROM up_walk w JOIN seeds USING (v) UNION ALL SELECT w.v, w.pt, -w.k FROM dn_walk w JOIN seeds USING (v) WHERE w.k > 0)"""
)


@_register(
    _knn(
        f"SELECT s.v AS traj_id, any_value(mn) AS min, any_value(mx) AS max, string_agg(p.pt, ',' ORDER BY p.k) AS path, {_r('any_value(h.y - l.y)')} AS total_change FROM seeds s JOIN ends USING (v) JOIN onpath p USING (v) JOIN fy h ON h.v = mx JOIN fy l ON l.v = mn GROUP BY s.v",
        _TRAJECTORIES,
        True,
    )
)
def trajectory_flow(spark, sf_dir):
    paths = W.trajectory_membership(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0))[0]
    return _rounded(paths.withColumn("path", F.concat_ws(",", "path")))


# Membership, cells, polarity, overlap

_SPREAD = f"{_OWN},{I.SQL_SPREAD}"
_WEIGHTS = _SPREAD + ",\nwt AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY v, direction) AS weight FROM spread)"
_CELLS = _WEIGHTS + ",\nce AS MATERIALIZED (SELECT a.v, a.extremum AS max_id, b.extremum AS min_id, a.weight * b.weight AS weight FROM wt a JOIN wt b USING (v) WHERE a.direction = 'max' AND b.direction = 'min')"


def _spread(spark, sf_dir, k: int = 0, graph=None):
    g = graph or I.knn(spark, sf_dir)
    return I.spread(g, I.owners(g, I.component(spark, sf_dir, k)))


@_register(_knn(f"SELECT v, direction, extremum, {_r('weight')} AS weight FROM wt", _WEIGHTS, True))
def membership_weights(spark, sf_dir):
    return _rounded(A.membership_weights(_spread(spark, sf_dir)))


@_register(_knn(f"SELECT v, max_id, min_id, {_r('weight')} AS weight FROM ce", _CELLS, True))
def cell_membership(spark, sf_dir):
    return _rounded(A.cells(A.membership_weights(_spread(spark, sf_dir))))


def _pol(theta: str, cells: str = "ce", f: str = "fy", name: str = "pol") -> str:
    return f""",
{name} AS MATERIALIZED (SELECT v, sum(weight * t) / sum(weight) AS theta, sum(weight * r) / sum(weight) AS range FROM (
  SELECT c.v, c.weight, h.y - l.y AS r, {theta} AS t FROM {cells} c JOIN {f} f ON f.v = c.v JOIN {f} h ON h.v = c.max_id JOIN {f} l ON l.v = c.min_id) WHERE t IS NOT NULL GROUP BY v)"""


_VALUE = "CASE WHEN h.y - l.y >= 1e-10 THEN greatest(0.0, least(1.0, (f.y - l.y) / (h.y - l.y + 1e-10))) END"
_RANK = "CASE WHEN count(*) OVER (PARTITION BY max_id, min_id) >= 2 THEN (rank() OVER (PARTITION BY max_id, min_id ORDER BY f.y) - 1 + (count(*) OVER (PARTITION BY max_id, min_id, f.y) - 1) / 2.0) / (count(*) OVER (PARTITION BY max_id, min_id) - 1) END"
_POLARITY = f"SELECT vertices.v, {_r('theta')} AS theta, {_r('2 * theta - 1')} AS polarity, {_r('range')} AS range FROM vertices LEFT JOIN pol ON pol.v = vertices.v"


@_register(_knn(_POLARITY, _CELLS + _pol(_VALUE), True))
def polarity_value(spark, sf_dir):
    return _rounded(A.polarity(I.component(spark, sf_dir, 0), A.membership_weights(_spread(spark, sf_dir))))


@_register(_knn(_POLARITY, _CELLS + _pol(_RANK), True))
def polarity_rank(spark, sf_dir):
    return _rounded(A.polarity(I.component(spark, sf_dir, 0), A.membership_weights(_spread(spark, sf_dir)), "rank"))


_OWN_Z = f",{I.sql_owners('fz', 'ownz')}"
_OVER = (
    _WEIGHTS
    + _OWN_Z
    + """,
wz AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY v, direction) AS weight FROM ownz),
ov AS MATERIALIZED (SELECT a.direction AS y_dir, a.extremum AS y_id, b.direction AS z_dir, b.extremum AS z_id, sum((1 + a.v % 3) * a.weight * b.weight) AS overlap FROM wt a JOIN wz b USING (v) GROUP BY ALL)"""
)


def _weights(spark, sf_dir):
    g = I.knn(spark, sf_dir)
    y, z = _fields(spark, sf_dir)
    return A.membership_weights(I.spread(g, I.owners(g, y))), A.membership_weights(I.owners(g, z))


@_register(_knn(f"SELECT y_dir, y_id, z_dir, z_id, {_r('overlap')} AS overlap FROM ov", _OVER, True))
def soft_overlap(spark, sf_dir):
    return _rounded(A.overlap(*_weights(spark, sf_dir), I.mass(spark, sf_dir)))


@_register(
    _knn(
        f"""SELECT y_dir, y_id, z_dir, z_id, {_r('o')} AS overlap, {_r('e')} AS expected, {_r('o - e')} AS delta, {_r('CASE WHEN room > 1e-15 THEN (o - e) / sqrt(room) ELSE 0.0 END', 7)} AS zeta FROM (
SELECT y_dir, y_id, z_dir, z_id, coalesce(overlap, 0.0) AS o, r * c / t AS e, r * c / t * (1 - r / t) * (1 - c / t) AS room
FROM (SELECT y_dir, z_dir, y_id, sum(overlap) AS r FROM ov GROUP BY ALL) JOIN (SELECT y_dir, z_dir, z_id, sum(overlap) AS c FROM ov GROUP BY ALL) USING (y_dir, z_dir)
JOIN (SELECT y_dir, z_dir, sum(overlap) AS t FROM ov GROUP BY ALL) USING (y_dir, z_dir) LEFT JOIN ov USING (y_dir, z_dir, y_id, z_id))""",
        _OVER,
        True,
    )
)
def overlap_deviation(spark, sf_dir):
    out = A.deviation(A.overlap(*_weights(spark, sf_dir), I.mass(spark, sf_dir)))
    return _rounded(out.withColumn("zeta", F.round("zeta", 7)))


_GF = (
    _CELLS
    + _OWN_Z
    + ",\nwz AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY v, direction) AS weight FROM ownz),\ncz AS MATERIALIZED (SELECT a.v, a.extremum AS max_id, b.extremum AS min_id, a.weight * b.weight AS weight FROM wz a JOIN wz b USING (v) WHERE a.direction = 'max' AND b.direction = 'min')"
    + _pol(_VALUE)
    + _pol(_VALUE, "cz", "fz", "polz")
    + ",\nas_ AS (SELECT v, (2 * pol.theta - 1) * (2 * polz.theta - 1) AS a FROM pol JOIN polz USING (v))"
)


def _polarities(spark, sf_dir):
    wy, wz = _weights(spark, sf_dir)
    y, z = _fields(spark, sf_dir)
    return wy, A.polarity(y, wy), A.polarity(z, wz)


@_register(_knn(f"SELECT v, {_r('a')} AS a_pol, (CASE WHEN a > 1e-10 THEN 1 WHEN a < -1e-10 THEN -1 WHEN a IS NOT NULL THEN 0 END)::INT AS s_pol FROM vertices LEFT JOIN as_ USING (v)", _GF, True))
def flow_association(spark, sf_dir):
    _, p, q = _polarities(spark, sf_dir)
    return _rounded(A.vertex_association(p, q))


@_register(
    _knn(
        f"SELECT {_r('sum((1 + v % 3) * a) / sum(1 + v % 3)')} AS a_pol, {_r('sum((1 + v % 3) * CASE WHEN a > 1e-10 THEN 1 WHEN a < -1e-10 THEN -1 ELSE 0 END)::DOUBLE / sum(1 + v % 3)')} AS kappa_pol, count(*) AS n FROM as_", _GF, True
    )
)
def flow_association_global(spark, sf_dir):
    _, p, q = _polarities(spark, sf_dir)
    return _rounded(A.global_association(A.vertex_association(p, q), I.mass(spark, sf_dir)))


@_register(_knn(f"SELECT direction, extremum, {_r('sum(weight * (2 * theta - 1)) / sum(weight)')} AS chi, {_r('sum(weight)')} AS mass FROM wt JOIN polz USING (v) GROUP BY direction, extremum", _GF, True))
def basin_character(spark, sf_dir):
    w, _, q = _polarities(spark, sf_dir)
    return _rounded(A.basin_character(w, q))


# Basin tables

_BT = _SPREAD + ",\nbt AS MATERIALIZED (SELECT s.direction, s.extremum, f.y AS value, count(DISTINCT s.v) AS size FROM spread s JOIN fy f ON f.v = s.extremum GROUP BY ALL)"


def _basins(spark, sf_dir):
    g, y = I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)
    from ..checkpoints import cut

    m = cut(I.spread(g, I.owners(g, y)))
    return g, y, m, B.basin_table(y, m)


@_register(_knn(f"SELECT direction, extremum, {_r('value')} AS value, size FROM bt", _BT, True))
def basin_table(spark, sf_dir):
    return _rounded(_basins(spark, sf_dir)[3])


@_register(
    _knn(
        f"SELECT direction, extremum, {_r('value / m', 6)} AS relative FROM bt, (SELECT avg(y) AS m FROM fy) WHERE (direction = 'max' AND value / m >= 1.1) OR (direction = 'min' AND value / m <= 0.9)", _BT, True
    )
)
def filter_relative(spark, sf_dir):
    _, y, _, b = _basins(spark, sf_dir)
    return _rounded(B.filter_relative(b, y).select("direction", "extremum", "relative"), 6)


@_register(_knn("SELECT direction, extremum, size FROM bt WHERE size >= 30", _BT, True))
def filter_support(spark, sf_dir):
    _, _, m, b = _basins(spark, sf_dir)
    return B.filter_support(b, m, 30).select("direction", "extremum", "size")


_OD = (
    _BT
    + """,
od AS MATERIALIZED (SELECT a.direction, a.extremum AS a, b.extremum AS b, 1 - count(*)::DOUBLE / least(any_value(x.size), any_value(z.size)) AS distance FROM spread a JOIN spread b ON a.v = b.v AND a.direction = b.direction AND a.extremum < b.extremum
  JOIN bt x ON x.direction = a.direction AND x.extremum = a.extremum JOIN bt z ON z.direction = b.direction AND z.extremum = b.extremum GROUP BY a.direction, a.extremum, b.extremum),
lk AS MATERIALIZED (SELECT a, b FROM od WHERE distance < 0.4 UNION ALL SELECT b, a FROM od WHERE distance < 0.4),
rc(a, b) AS (SELECT extremum, extremum FROM bt UNION SELECT r.a, l.b FROM rc r JOIN lk l ON l.a = r.b),
cl AS MATERIALIZED (SELECT bt.direction, bt.extremum, bt.value, c FROM bt JOIN (SELECT a, min(b) AS c FROM rc GROUP BY a) ON a = extremum),
rp AS MATERIALIZED (SELECT direction, extremum, c AS cluster, first_value(extremum) OVER (PARTITION BY direction, c ORDER BY CASE direction WHEN 'max' THEN -value ELSE value END, extremum) AS representative FROM cl)"""
)


@_register(_knn(f"SELECT direction, a, b, {_r('distance')} AS distance FROM od", _OD, True))
def overlap_distances(spark, sf_dir):
    return _rounded(B.overlap_distances(_basins(spark, sf_dir)[2]))


@_register(_knn("SELECT direction, extremum, cluster, representative FROM rp", _OD, True))
def cluster_basins(spark, sf_dir):
    _, _, m, b = _basins(spark, sf_dir)
    return B.cluster_basins(b, m, 0.4)


@_register(_knn("SELECT DISTINCT v, direction, representative AS extremum FROM spread JOIN rp USING (direction, extremum)", _OD, True))
def merged_clusters(spark, sf_dir):
    _, _, m, b = _basins(spark, sf_dir)
    return B.merge_clusters(m, B.cluster_basins(b, m, 0.4))


@_register(_knn("SELECT v, direction, extremum FROM spread JOIN bt USING (direction, extremum) QUALIFY row_number() OVER (PARTITION BY v, direction ORDER BY CASE direction WHEN 'max' THEN -value ELSE value END, extremum) = 1", _BT, True))
def primary_assignment(spark, sf_dir):
    _, _, m, b = _basins(spark, sf_dir)
    return B.primary(b, m)


@_register(
    _knn(
        f"""SELECT a_dir, a, b_dir, b, common, {_r('2.0 * common / (x.size + z.size)')} AS weight FROM (
SELECT a.direction AS a_dir, a.extremum AS a, b.direction AS b_dir, b.extremum AS b, count(*) AS common FROM spread a JOIN spread b USING (v)
WHERE a.direction < b.direction OR (a.direction = b.direction AND a.extremum < b.extremum) GROUP BY ALL HAVING count(*) >= 3) JOIN bt x ON x.direction = a_dir AND x.extremum = a JOIN bt z ON z.direction = b_dir AND z.extremum = b""",
        _BT,
        True,
    )
)
def flow_graph(spark, sf_dir):
    return _rounded(B.flow_graph(_basins(spark, sf_dir)[2], 3))


@_register(_knn("SELECT a.extremum AS max_id, b.extremum AS min_id, count(DISTINCT v) AS size FROM spread a JOIN spread b USING (v) WHERE a.direction = 'max' AND b.direction = 'min' GROUP BY ALL HAVING count(DISTINCT v) >= 4", _SPREAD, True))
def flow_cells(spark, sf_dir):
    return B.flow_cells(_basins(spark, sf_dir)[2], 4)


@_register(
    _knn(
        f"""SELECT direction, rank, CASE direction WHEN 'max' THEN 'M' ELSE 'm' END || rank AS label, extremum, {_r('value')} AS value, {_r('value / m', 6)} AS relative, size, degree FROM (
SELECT *, row_number() OVER (PARTITION BY direction ORDER BY CASE direction WHEN 'max' THEN -value ELSE value END, extremum)::INT AS rank FROM bt), (SELECT avg(y) AS m FROM fy), (SELECT src, count(*) AS degree FROM edges GROUP BY src) WHERE src = extremum""",
        _BT,
        True,
    )
)
def basin_summary(spark, sf_dir):
    g, y, _, b = _basins(spark, sf_dir)
    return _rounded(B.summary(g, b, y).withColumn("relative", F.round("relative", 6)))


@_register(_knn("SELECT DISTINCT src AS v FROM edges SEMI JOIN inn ON inn.v = src ANTI JOIN inn i2 ON i2.v = dst", ",\ninn AS (SELECT v FROM fy WHERE y > 0)"))
def set_boundary(spark, sf_dir):
    return B.boundary(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0).filter("y > 0").select("v"))


@_register(
    _knn(
        f"SELECT v, c.extremum, {_r('dist')} AS dist FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY v ORDER BY dist, ref) = 1) s JOIN cov c ON c.u = s.ref",
        _BT + ",\ncov AS MATERIALIZED (SELECT s.v AS u, max(s.extremum) AS extremum FROM spread s JOIN (SELECT DISTINCT extremum FROM bt WHERE size >= 60) b USING (extremum) WHERE s.direction = 'max' GROUP BY s.v)" + _sp("(SELECT u AS v FROM cov)"),
        True,
    )
)
def expand_to_cover(spark, sf_dir):
    g, y, m, b = _basins(spark, sf_dir)
    return _rounded(B.expand_to_cover(g, B.keep(m, B.filter_support(b, m, 60)), "max"))


@_register(
    _knn(
        f"SELECT direction, extremum, {_r('value')} AS value, size FROM bt JOIN geo ON geo.v = extremum WHERE pn < 0.9 AND ph < 0.9 AND pd <= 0.9",
        _BT
        + """,
two AS (SELECT a.src, b.dst, min(a.len + b.len) AS len FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.src, b.dst),
far AS MATERIALIZED (SELECT src AS v, avg(len) AS m FROM two t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = t.src AND e.dst = t.dst) GROUP BY src),
geo AS MATERIALIZED (SELECT v, cume_dist() OVER (ORDER BY n) AS pn, cume_dist() OVER (ORDER BY m NULLS FIRST) AS ph, cume_dist() OVER (ORDER BY d DESC) AS pd FROM (SELECT src AS v, avg(len) AS n, count(*) AS d FROM edges GROUP BY src) LEFT JOIN far USING (v))""",
        True,
    )
)
def filter_geometry(spark, sf_dir):
    g, _, _, b = _basins(spark, sf_dir)
    return _rounded(B.filter_geometry(b, B.geometry(g), 0.9, 0.9, 0.9))


@_register(
    "WITH l AS (SELECT c.c_nationkey AS a, o.o_orderpriority AS b FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey), n AS (SELECT a, b, count(*) AS n FROM l GROUP BY a, b) "
    "SELECT x.a, y.b, coalesce(n.n, 0)::BIGINT AS n FROM (SELECT DISTINCT a FROM l) x CROSS JOIN (SELECT DISTINCT b FROM l) y LEFT JOIN n ON n.a = x.a AND n.b = y.b"
)
def contingency_table(spark, sf_dir):
    j = I.table(spark, sf_dir, "orders").join(I.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return B.contingency(j, "c_nationkey", "o_orderpriority")


@_register(
    _path(
        f"SELECT extremum AS cell, count(*) AS n, {_r('avg(y)', 4)} AS mean, min(y) AS low, max(y) AS high, {_r('median(y)', 4)} AS median FROM own_max JOIN fy USING (v) GROUP BY extremum", _OWN, True
    )
)
def cell_values(spark, sf_dir):
    g, y = I.orders_path(spark, sf_dir), I.price(spark, sf_dir)
    cells = roots(W.steepest(g, y)).select("v", F.col("root").alias("cell"))
    out = B.cell_values(cells, y)
    return out.withColumn("mean", F.round("mean", 4) + 0.0).withColumn("median", F.round("median", 4) + 0.0)


@_register(
    "WITH f AS (SELECT vec_id AS v, 'f' || k AS feature, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS k)) "
    "SELECT feature, count(*) FILTER (value > 0.5) AS carriers, round(avg((value > 0.5)::INT), 9) + 0.0 AS share FROM f WHERE v IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0) GROUP BY feature"
)
def feature_carriers(spark, sf_dir):
    f = I.features(spark, sf_dir, range(64))
    return _rounded(B.carriers(f, I.component(spark, sf_dir, 0).filter("y > 0").select("v"), 0.5))


@_register(
    "WITH f AS (SELECT vec_id AS v, 'f' || k AS feature, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS k)) "
    "SELECT v, rank::INT AS rank, feature, round(value, 9) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY value DESC, feature) AS rank FROM f WHERE value > 0) WHERE rank <= 5"
)
def feature_profiles(spark, sf_dir):
    return _rounded(B.profile(I.features(spark, sf_dir, range(64)), 5))


@_register(
    "WITH r AS (SELECT o_custkey, o_totalprice > 150000 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), "
    "s AS (SELECT o_custkey, i, i - row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS g FROM r WHERE f), "
    "t AS (SELECT o_custkey, min(i)::INT AS start, count(*) AS length FROM s GROUP BY o_custkey, g) "
    "SELECT o_custkey, start, length FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY length DESC, start) = 1"
)
def longest_run(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders").withColumn("f", F.col("o_totalprice") > 150000)
    return B.longest_run(o, "o_custkey", ["o_orderdate", "o_orderkey"], "f")


# Merge trees

_CUT = """,
act AS MATERIALIZED (SELECT v, y FROM fy WHERE y >= 200000),
ce AS MATERIALIZED (SELECT src, dst FROM edges SEMI JOIN act a ON a.v = src SEMI JOIN act b ON b.v = dst),
reach(a, b) AS (SELECT v, v FROM act UNION SELECT r.a, c.dst FROM reach r JOIN ce c ON c.src = r.b),
comp AS MATERIALIZED (SELECT a AS v, min(b) AS component FROM reach GROUP BY a)"""


@_register(_path("SELECT component, arg_min(v, (-y, v)) AS extremum, max(y) AS value, count(*) AS size FROM comp JOIN act USING (v) GROUP BY component".replace("arg_min(v, (-y, v))", "first(v ORDER BY y DESC, v)"), _CUT, True))
def merge_tree_cut(spark, sf_dir):
    return M.cut_tree(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), 200000.0)[0]


# Peaks reach a vertex at the highest level of all paths' lowest points; at a vertex the peaks above its higher neighbours meet.
# Isolated vertices are peaks too. Neighbours of equal value do not occur in these fields.
_MERGES = (
    _NEAR
    + """,
peak AS MATERIALIZED (SELECT f.v, f.y FROM fy f LEFT JOIN nb ON src = f.v WHERE hi IS NULL OR hi < y),
bn(m, v, b) USING KEY (m, v) AS (SELECT v, v, y FROM peak UNION SELECT n.m, e.dst, max(least(n.b, e.yd)) FROM bn n JOIN ev e ON e.src = n.v LEFT JOIN recurring.bn r ON r.m = n.m AND r.v = e.dst WHERE r.b IS NULL OR least(n.b, e.yd) > r.b GROUP BY n.m, e.dst),
own AS MATERIALIZED (SELECT e.src AS s, e.dst AS u, first(n.m ORDER BY p.y DESC, n.m) AS m FROM ev e JOIN bn n ON n.v = e.dst AND n.b > e.ys JOIN peak p ON p.v = n.m WHERE e.yd > e.ys GROUP BY e.src, e.dst),
met AS MATERIALIZED (SELECT DISTINCT s, m, first_value(m) OVER (PARTITION BY s ORDER BY p.y DESC, m) AS best FROM own JOIN peak p ON p.v = m),
event AS MATERIALIZED (SELECT m AS losing, best AS surviving, s AS plateau, f.y AS level, p.y AS birth, p.y - f.y AS persistence, 'merged' AS status FROM met JOIN fy f ON f.v = s JOIN peak p ON p.v = m WHERE m <> best),
life AS MATERIALIZED (SELECT p.v AS basin, p.y AS birth, coalesce(e.level, (SELECT min(f.y) FROM bn n JOIN fy f ON f.v = n.v WHERE n.m = p.v)) AS death, e.surviving AS parent FROM peak p LEFT JOIN event e ON e.losing = p.v)"""
)
_LIFE = f"SELECT basin, {_r('birth')} AS birth, {_r('death')} AS death, {_r('birth - death')} AS persistence, parent FROM life"


@_register(_knn(f"SELECT losing, surviving, plateau, {_r('level')} AS level, {_r('birth')} AS birth, {_r('persistence')} AS persistence, status FROM event", _MERGES, True))
def merge_tree_events(spark, sf_dir):
    return _rounded(M.merge_tree(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), assign=False)[0])


@_register(_path(_LIFE, _MERGES, True))
def merge_tree_basins(spark, sf_dir):
    return _rounded(M.merge_tree(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), assign=False)[1])


@_register(_knn(_LIFE, _MERGES, True))
def persistence(spark, sf_dir):
    return _rounded(M.persistence(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)))


# The survivor at the level of a vertex is the highest peak that reaches it there.
@_register(_path("SELECT n.v, first(n.m ORDER BY p.y DESC, n.m) AS basin FROM bn n JOIN fy f ON f.v = n.v JOIN peak p ON p.v = n.m WHERE n.b >= f.y GROUP BY n.v", _MERGES, True))
def merge_tree_assignment(spark, sf_dir):
    return M.merge_tree(I.orders_path(spark, sf_dir), I.price(spark, sf_dir))[2]


@_register(
    _knn(
        f"SELECT t.basin, row_number() OVER (ORDER BY path)::INT AS x, {_r('birth')} AS birth, {_r('death')} AS death, parent FROM tr t JOIN life USING (basin)",
        _MERGES + ",\ntr(basin, path) AS (SELECT basin, [{'k': death - birth, 'b': basin}] FROM life WHERE parent IS NULL UNION ALL SELECT l.basin, list_append(t.path, {'k': l.death - l.birth, 'b': l.basin}) FROM tr t JOIN life l ON l.parent = t.basin)",
        True,
    )
)
def merge_tree_layout(spark, sf_dir):
    return _rounded(M.layout(M.merge_tree(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), assign=False)[1]))


# Paths and monotone graphs


@_register(
    _path(
        "SELECT ref, v, hop::INT AS hop FROM lv WHERE hop <= 6",
        _bfs("vertices"),
        True,
    )
)
def hop_distances(spark, sf_dir):
    g = I.orders_path(spark, sf_dir)
    return hops(g.edges, g.vertices.select(F.col("v").alias("ref"), "v"), 6)


_LINE = (
    _sp("(SELECT 0 AS v)", name="sa")
    + """,
line(v, k) AS (SELECT 99, 0 UNION ALL SELECT p.src, p.k FROM (SELECT e.src, l.k + 1 AS k, row_number() OVER (PARTITION BY l.v ORDER BY e.src) AS rn FROM line l JOIN sa d ON d.v = l.v JOIN edges e ON e.dst = l.v JOIN sa p ON p.v = e.src WHERE p.dist + e.len = d.dist AND l.v <> 0) p WHERE rn = 1),
path AS MATERIALIZED (SELECT (SELECT max(k) FROM line) - k AS position, v, dist FROM line JOIN sa USING (v))"""
)


@_register(_knn(f"SELECT position::INT AS position, v::BIGINT AS v, {_r('dist')} AS dist FROM path", _LINE, True))
def shortest_paths(spark, sf_dir):
    return _rounded(P.shortest_path(I.knn(spark, sf_dir), 0, 99))


@_register(
    _knn(
        f"""SELECT n.v::BIGINT AS v, path.v IS NOT NULL AS on_path, {_r('(l + s.dist - z.dist) / (2 * l)', 7)} AS t, {_r('n.dist', 7)} AS dist, {_r('s.dist + z.dist - l', 7)} AS excess, s.dist + z.dist - l <= 0.5 AS in_excess
FROM (SELECT v, min(dist) AS dist FROM sp GROUP BY v) n JOIN sa s USING (v) JOIN se z USING (v) LEFT JOIN path ON path.v = n.v, (SELECT max(dist) AS l FROM path) WHERE n.dist <= 0.5 * l AND s.dist <= l AND z.dist <= l""",
        _LINE + _sp("(SELECT 99 AS v)", name="se") + _sp("path"),
        True,
    )
)
def tube_lens_corridor(spark, sf_dir):
    return _rounded(P.tube_lens(I.knn(spark, sf_dir), 0, 99, 0.5, 0.5).drop("t_harmonic"), 7)


@_register()
def tube_lens_harmonic(spark, sf_dir):
    return _rounded(P.tube_lens(I.knn(spark, sf_dir), 0, 99, 0.5, 0.5).select("v", "t_harmonic"), 7)


@_register()
def harmonic_extension(spark, sf_dir):
    y = I.component(spark, sf_dir, 0)
    return _rounded(P.harmonic_extension(I.knn(spark, sf_dir), y.select("v", F.when(F.col("v") % 10 == 0, F.col("y")).alias("value"))), 7)


@_register(_knn("SELECT src, dst, round(len, 9) + 0.0 AS len FROM ev, lim WHERE yd > ys AND len <= q", _LIMIT))
def monotone_edges(spark, sf_dir):
    return _rounded(P.monotone_edges(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), 0.9))


_MADAG = """,
lm AS (SELECT quantile_cont(len, 0.3) AS q FROM edges WHERE src < dst),
de AS MATERIALIZED (SELECT src, dst FROM ev, lm WHERE yd > ys AND len <= q),
src AS (SELECT v AS s FROM fy ORDER BY y, v LIMIT 1),
wk(v, k) AS (SELECT s, 1 FROM src UNION ALL SELECT d.dst, w.k + 1 FROM wk w JOIN de d ON d.src = w.v),
fr AS MATERIALIZED (SELECT v, count(*) AS c FROM wk GROUP BY v)"""


def _lowest(y):
    return y.orderBy("y", "v").first()["v"]


@_register(_knn("SELECT v, round(y, 9) + 0.0 AS y, c::BIGINT AS from_source, NOT EXISTS (SELECT 1 FROM de WHERE de.src = fr.v) AS is_sink FROM fr JOIN fy USING (v)", _MADAG, True))
def madag(spark, sf_dir):
    y = I.component(spark, sf_dir, 0)
    vs = P.madag(I.knn(spark, sf_dir), y, _lowest(y), 0.3)[0]
    return _rounded(vs.select("v", "y", F.col("from_source").cast("long").alias("from_source"), "is_sink"))


@_register(
    _knn(
        "SELECT b.v, round(f.c * b.c / t.c::DOUBLE, 9) + 0.0 AS share FROM (SELECT v, count(*) AS c FROM bk GROUP BY v) b JOIN fr f USING (v), (SELECT c FROM fr JOIN pick USING (v)) t WHERE b.v NOT IN (SELECT v FROM pick) AND b.v NOT IN (SELECT s FROM src) AND f.c * b.c / t.c::DOUBLE >= 0.25",
        _MADAG + ",\npick AS MATERIALIZED (SELECT v FROM fr WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.src = fr.v) ORDER BY c DESC, v LIMIT 1),\nbk(v, k) AS (SELECT v, 1 FROM pick UNION ALL SELECT d.src, b.k + 1 FROM bk b JOIN de d ON d.dst = b.v SEMI JOIN fr ON fr.v = d.src)",
        True,
    )
)
def madag_bottlenecks(spark, sf_dir):
    y = I.component(spark, sf_dir, 0)
    s = _lowest(y)
    vs, e = P.madag(I.knn(spark, sf_dir), y, s, 0.3)
    top = vs.filter("is_sink").orderBy(F.col("from_source").desc(), "v").first()["v"]
    return _rounded(P.bottlenecks(vs, e, s, top, 0.25))


def _geodesic(spark, sf_dir):
    g, y = I.orders_path(spark, sf_dir), I.price(spark, sf_dir)
    return g, y, P.geodesic_basins(g, y, X.extrema_table(g, y).select("v", "type"))


_SEARCH = (
    _EXT
    + _LIMIT
    + """,
gb(extremum, type, v, hop, dist, pred) AS (SELECT v, type, v, 0, 0.0::DOUBLE, NULL::BIGINT FROM ext UNION ALL SELECT g.extremum, g.type, e.dst, g.hop + 1, g.dist + e.len, g.v FROM gb g JOIN ev e ON e.src = g.v, lim
  WHERE e.len <= q AND CASE g.type WHEN 'max' THEN e.yd < e.ys ELSE e.yd > e.ys END)"""
)


# Components of this graph are paths, so that a vertex is met from one side only.
@_register(_path("SELECT extremum, type, v, hop::INT AS hop, dist, pred FROM gb", _SEARCH, True))
def geodesic_basins(spark, sf_dir):
    return _geodesic(spark, sf_dir)[2]


@_register(
    _path(
        "SELECT extremum, type, v FROM gb g WHERE NOT EXISTS (SELECT 1 FROM ev e JOIN gb o ON o.extremum = g.extremum AND o.type = g.type AND o.v = e.dst WHERE e.src = g.v AND CASE g.type WHEN 'max' THEN e.yd < e.ys ELSE e.yd > e.ys END)",
        _SEARCH,
        True,
    )
)
def basin_terminals(spark, sf_dir):
    return P.terminals(*_geodesic(spark, sf_dir))


# Grids

_N = 24
_F = "sin(6 * x) * cos(5 * y) + 0.3 * x"


def _grid(spark):
    return G.evaluate(G.create_grid(spark, _N), F.expr(_F))


_GRID = f"g AS MATERIALIZED (SELECT i, j, (i - 1) * {_N} + j AS v, sin(6 * x) * cos(5 * y) + 0.3 * x AS f FROM (SELECT i, j, (i - 1) / {_N - 1}.0::DOUBLE AS x, (j - 1) / {_N - 1}.0::DOUBLE AS y FROM (SELECT unnest(range(1, {_N + 1})) AS i), (SELECT unnest(range(1, {_N + 1})) AS j)))"
_STEPS = ", s AS (SELECT * FROM (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) t(k, a, b)), nb AS MATERIALIZED (SELECT g.v, g.f, s.k, n.v AS nv, n.f AS nf FROM g, s JOIN g n ON n.i = g.i + s.a AND n.j = g.j + s.b)"


@_register(f"WITH {_GRID} SELECT i, j, round(f, 9) + 0.0 AS f FROM g")
def grid_function(spark, sf_dir):
    return _rounded(_grid(spark))


@_register(f"WITH {_GRID}{_STEPS}, e AS (SELECT v, max(nf) AS hi, min(nf) AS lo FROM nb GROUP BY v) SELECT i, j, 'max' AS type FROM g JOIN e USING (v) WHERE hi <= f UNION ALL SELECT i, j, 'min' FROM g JOIN e USING (v) WHERE lo >= f")
def grid_critical_points(spark, sf_dir):
    return G.critical_points(_grid(spark)).select("i", "j", "type")


_WALKS = "".join(
    f", {n}n AS MATERIALIZED (SELECT v, nv FROM nb WHERE nf {c} f QUALIFY row_number() OVER (PARTITION BY v ORDER BY nf {o}, k) = 1), {n}w(v, pt) AS (SELECT v, v FROM g UNION ALL SELECT w.v, n.nv FROM {n}w w JOIN {n}n n ON n.v = w.pt), {n} AS (SELECT w.v, w.pt FROM {n}w w ANTI JOIN {n}n n ON n.v = w.pt)"
    for n, c, o in (("up", ">", "DESC"), ("dn", "<", "ASC"))
)


@_register(
    f"WITH RECURSIVE {_GRID}{_STEPS}{_WALKS}, p AS (SELECT up.v, dn.pt AS min_v, up.pt AS max_v FROM up JOIN dn ON dn.v = up.v), c AS (SELECT min_v, max_v, row_number() OVER (ORDER BY min(v))::INT AS cell FROM p GROUP BY min_v, max_v) "
    f"SELECT (v - 1) // {_N} + 1 AS i, (v - 1) % {_N} + 1 AS j, min_v, max_v, cell FROM p JOIN c USING (min_v, max_v)"
)
def grid_cells(spark, sf_dir):
    return G.cells(_grid(spark), _N)


@_register(f"WITH RECURSIVE {_GRID}{_STEPS}{_WALKS} SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS position, i, j FROM upw JOIN g ON g.v = upw.pt WHERE upw.v = 1")
def grid_walk(spark, sf_dir):
    return G.walk(_grid(spark), _N, 1, 1)


# Ties on a star

_STAR = "edges AS (SELECT n_nationkey::BIGINT AS src, 1000 + n_regionkey::BIGINT AS dst FROM nation UNION ALL SELECT 1000 + n_regionkey::BIGINT, n_nationkey::BIGINT FROM nation), fy AS (SELECT n_nationkey::BIGINT AS v, (n_nationkey % 3)::DOUBLE AS y FROM nation UNION ALL SELECT 1000 + r_regionkey::BIGINT, 2.0 FROM region)"


@_register(f"WITH {_STAR}, nb AS (SELECT src, min(b.y) AS lo, max(b.y) AS hi FROM edges JOIN fy b ON b.v = dst GROUP BY src) SELECT f.v, y, lo >= y AS is_min, hi <= y AS is_max FROM fy f JOIN nb ON src = f.v")
def star_ties(spark, sf_dir):
    n, r = I.table(spark, sf_dir, "nation"), I.table(spark, sf_dir, "region")
    g = from_edges(n.select(F.col("n_nationkey").cast("long").alias("a"), (1000 + F.col("n_regionkey").cast("long")).alias("b"), F.lit(1.0).alias("len")))
    y = n.select(F.col("n_nationkey").cast("long").alias("v"), (F.col("n_nationkey") % 3).cast("double").alias("y")).union(r.select((1000 + F.col("r_regionkey").cast("long")), F.lit(2.0)))
    return X.weak_extrema(g, y)


# Column functions


@_register(
    """SELECT p_partkey, round(ln(p_retailprice), 9) + 0.0 AS bc0, round((sqrt(p_retailprice) - 1) / 0.5, 9) + 0.0 AS bc5, round(asin(sqrt(p_size / 100.0::DOUBLE)), 9) + 0.0 AS asn, round(1 / (1 + exp(-p_size / 10.0::DOUBLE)), 9) + 0.0 AS lgt,
  round(tanh(p_size / 10.0::DOUBLE), 9) + 0.0 AS th, round(atan(p_size / 10.0::DOUBLE) * 2 / pi(), 9) + 0.0 AS atn, round((p_size / 10.0::DOUBLE) / sqrt(1 + pow(p_size / 10.0::DOUBLE, 2)), 9) + 0.0 AS al,
  round(CASE WHEN p_size / 30.0::DOUBLE < 1 THEN pow(1 - pow(p_size / 30.0::DOUBLE, 3), 3) ELSE 0.0 END, 9) + 0.0 AS tri, round(exp(-pow(p_size / 30.0::DOUBLE, 2) / 2), 9) + 0.0 AS nrm FROM part"""
)
def transforms(spark, sf_dir):
    p, s = I.table(spark, sf_dir, "part"), F.col("p_size")
    u = s / 10.0
    return _rounded(
        p.select(
            "p_partkey",
            scalars.box_cox(F.col("p_retailprice"), 0.0).alias("bc0"),
            scalars.box_cox(F.col("p_retailprice"), 0.5).alias("bc5"),
            scalars.arcsine_sqrt(s / 100.0).alias("asn"),
            scalars.logistic(u).alias("lgt"),
            scalars.sigmoid(u, "tanh").alias("th"),
            scalars.sigmoid(u, "arctan").alias("atn"),
            scalars.sigmoid(u, "algebraic").alias("al"),
            scalars.kernel(s / 30.0, "tricube").alias("tri"),
            scalars.kernel(s / 30.0, "normal").alias("nrm"),
        )
    )


@_register(
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), t AS (SELECT o_custkey, sum(n) AS s, count(*) AS k FROM c GROUP BY o_custkey)
SELECT o_custkey, round(-sum(n / s * ln(n / s)), 9) + 0.0 AS entropy, CASE WHEN any_value(k) > 1 THEN round(-sum(n / s * ln(n / s)) / ln(any_value(k)), 9) + 0.0 ELSE 0.0 END AS evenness, round(max(ln(n)) - avg(ln(n)), 9) + 0.0 AS top_clr FROM c JOIN t USING (o_custkey) GROUP BY o_custkey"""
)
def diversity(spark, sf_dir):
    c = I.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    a = c.groupBy("o_custkey").agg(F.sort_array(F.collect_list("n")).alias("ns"))
    return _rounded(a.select("o_custkey", scalars.entropy("ns").alias("entropy"), scalars.evenness("ns").alias("evenness"), F.array_max(scalars.centred_log_ratio("ns")).alias("top_clr")))


# Statistics


@_register(
    _path(
        """SELECT n, round((n00 + n11) / n, 9) + 0.0 AS concordance, round(chi, 7) + 0.0 AS chi_sq, round(sqrt(chi / n), 9) + 0.0 AS cramer_v, round(n00 * n11 / (n01 * n10), 9) + 0.0 AS odds_ratio FROM (
SELECT *, pow(abs(n00 - e00) - fx, 2) / e00 + pow(abs(n01 - e01) - fx, 2) / e01 + pow(abs(n10 - e10) - fx, 2) / e10 + pow(abs(n11 - e11) - fx, 2) / e11 AS chi FROM (
SELECT *, least(0.5, abs(n00 - e00), abs(n01 - e01), abs(n10 - e10), abs(n11 - e11)) AS fx FROM (
SELECT *, n00 + n01 + n10 + n11 AS n, (n00 + n01) * (n00 + n10) / (n00 + n01 + n10 + n11) AS e00, (n00 + n01) * (n01 + n11) / (n00 + n01 + n10 + n11) AS e01, (n10 + n11) * (n00 + n10) / (n00 + n01 + n10 + n11) AS e10, (n10 + n11) * (n01 + n11) / (n00 + n01 + n10 + n11) AS e11 FROM (
SELECT count(*) FILTER (yd <= ys AND zd <= zs)::DOUBLE AS n00, count(*) FILTER (yd <= ys AND zd > zs)::DOUBLE AS n01, count(*) FILTER (yd > ys AND zd <= zs)::DOUBLE AS n10, count(*) FILTER (yd > ys AND zd > zs)::DOUBLE AS n11 FROM ev WHERE src < dst))))"""
    )
)
def concordance_test(spark, sf_dir):
    d = A.lcor_matrix(I.orders_path(spark, sf_dir), I.price(spark, sf_dir), A.one_feature(I.residue(spark, sf_dir)), kind="unit", edges=True)
    out = stats.concordance_test(d.filter("src < dst"))
    return _rounded(out.withColumn("chi_sq", F.round("chi_sq", 7)))


@_register(
    """WITH p AS (SELECT c_acctbal AS x, count(*) FILTER (c_mktsegment = 'BUILDING')::DOUBLE AS a, count(*) FILTER (c_mktsegment = 'MACHINERY')::DOUBLE AS b FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_acctbal),
q AS (SELECT x, abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS d, lead(x) OVER (ORDER BY x) - x AS w FROM p) SELECT round(coalesce(sum(d * w), 0.0), 6) + 0.0 AS distance FROM q"""
)
def wasserstein_distance(spark, sf_dir):
    return _rounded(stats.wasserstein(I.table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY"), 6)


@_register(
    "SELECT c_mktsegment, k, n, round((k + 1.0::DOUBLE) / (n + 2), 9) + 0.0 AS post_mean, round(sqrt((k + 1.0::DOUBLE) * (n - k + 1) / (pow(n + 2.0::DOUBLE, 2) * (n + 3))), 9) + 0.0 AS post_sd FROM (SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0) AS k, count(*) AS n FROM customer GROUP BY c_mktsegment)"
)
def beta_binomial(spark, sf_dir):
    c = I.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.sum((F.col("c_acctbal") > 0).cast("long")).alias("k"), F.count("*").alias("n"))
    return _rounded(stats.beta_binomial(c).drop("post_a", "post_b"))


@_register("SELECT p_partkey, round(avg(p_retailprice) OVER (ORDER BY p_partkey ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) + 0.0 AS running_mean FROM part")
def running_mean(spark, sf_dir):
    return _rounded(stats.running_mean(I.table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", 5).select("p_partkey", "running_mean"), 6)


@_register()
def bootstrap_means(spark, sf_dir):
    return _rounded(stats.bootstrap_means(I.component(spark, sf_dir, 0), "y", 50))


# Compositions


@_register(
    _knn(
        f"""SELECT v, type, CASE type WHEN 'max' THEN 'M' ELSE 'm' END || row_number() OVER (PARTITION BY type ORDER BY CASE type WHEN 'max' THEN -y ELSE y END, v) AS label, {_r('y')} AS y, {_r('score')} AS score, degree FROM (
SELECT v, 'max' AS type, maxp AS score, y, degree FROM sc, qs JOIN fy USING (v) WHERE maxp >= qa AND degree >= qd UNION ALL SELECT v, 'min', minp, y, degree FROM sc, qs JOIN fy USING (v) WHERE minp >= qi AND degree >= qd)""".replace("FROM sc, qs JOIN fy USING (v)", "FROM sc JOIN fy USING (v), qs"),
        """,
sc AS MATERIALIZED (SELECT src AS v, avg((yd < ys)::INT) AS maxp, avg((yd > ys)::INT) AS minp, count(*) AS degree FROM ev GROUP BY src),
qs AS (SELECT quantile_cont(maxp, 0.95) AS qa, quantile_cont(minp, 0.95) AS qi, quantile_cont(degree, 0.1) AS qd FROM sc)""",
    )
)
def extremality_summary(spark, sf_dir):
    g, y = I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)
    return _rounded(B.extremality_summary(g, y, X.neighbour_share(g, y)))


@_register(
    _knn(
        "SELECT max_id, min_id, size FROM c, (SELECT quantile_cont(size, 0.5) AS q FROM c) WHERE size >= q AND size <= 40",
        _SPREAD + ",\nc AS MATERIALIZED (SELECT a.extremum AS max_id, b.extremum AS min_id, count(DISTINCT v) AS size FROM spread a JOIN spread b USING (v) WHERE a.direction = 'max' AND b.direction = 'min' GROUP BY ALL)",
        True,
    )
)
def filter_cells(spark, sf_dir):
    return B.filter_cells(B.flow_cells(_basins(spark, sf_dir)[2]), max_size=40, low=0.5)


@_register(
    _knn(
        "SELECT v, arg_min(dst, (-gain, dst)) AS next FROM vertices LEFT JOIN (SELECT src, dst, yd - ys AS gain FROM ev WHERE yd > ys AND len <= 10.0) ON src = v GROUP BY v".replace("arg_min(dst, (-gain, dst))", "first(dst ORDER BY gain DESC, dst)")
    )
)
def bounded_steps(spark, sf_dir):
    from ..graph import Graph

    g = I.knn(spark, sf_dir)
    return W.next_vertex(Graph(g.vertices, g.edges.filter("len <= 10")), I.component(spark, sf_dir, 0), True, "none", 1.0).select("v", "next")


@_register(
    _knn(
        "SELECT vertices.v, n.v AS next FROM vertices LEFT JOIN (SELECT s.ref, s.v FROM sp s JOIN fy a ON a.v = s.ref JOIN fy b ON b.v = s.v WHERE b.y > a.y QUALIFY row_number() OVER (PARTITION BY s.ref ORDER BY b.y - a.y DESC, s.dist, s.v) = 1) n ON n.ref = vertices.v",
        _sp("vertices", "s.dist + e.len <= 12"),
        True,
    )
)
def scale_flow(spark, sf_dir):
    return P.scale_flow(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), 12.0)


@_register(
    _knn(
        "SELECT vertices.v, n.v AS next FROM vertices LEFT JOIN (SELECT s.ref, s.v FROM sp s JOIN su u ON u.ref = s.ref AND u.v = s.v JOIN fy b ON b.v = s.v WHERE s.ref <> s.v AND u.dist <= s.dist + 1e-12 QUALIFY row_number() OVER (PARTITION BY s.ref ORDER BY b.y DESC, s.dist, s.v) = 1) n ON n.ref = vertices.v",
        ",\neu AS MATERIALIZED (SELECT src, dst, len FROM ev WHERE yd > ys)" + _sp("vertices", "s.dist + e.len <= 20") + _sp("vertices", "s.dist + e.len <= 20", "su", "eu"),
        True,
    )
)
def constrained_flow(spark, sf_dir):
    g = I.knn(spark, sf_dir)
    return P.constrained_flow(g, g, I.component(spark, sf_dir, 0), 20.0)


@_register()
def smoothed_field(spark, sf_dir):
    return _rounded(P.smooth_spurious(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), 2, rounds=1)[0], 6)


@_register()
def biharmonic_extension(spark, sf_dir):
    y = I.component(spark, sf_dir, 0)
    return _rounded(P.harmonic_extension(I.knn(spark, sf_dir), y.select("v", F.when(F.col("v") % 4 == 0, F.col("y")).alias("value")), method="biharmonic"), 5)


@_register(
    _knn(
        f"SELECT vertices.v, {_r('value', 7)} AS value FROM vertices LEFT JOIN ring USING (v)",
        """,
ring(v, value, k) USING KEY (v) AS (SELECT v, y, 0 FROM fy WHERE v % 4 = 0 UNION SELECT e.src, sum(r.value / greatest(e.len, 1e-12)) / sum(1 / greatest(e.len, 1e-12)), max(t.k) + 1
  FROM edges e JOIN recurring.ring r ON r.v = e.dst, (SELECT max(k) AS k FROM ring) t WHERE t.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM recurring.ring o WHERE o.v = e.src) GROUP BY e.src)""",
        True,
    )
)
def weighted_mean_extension(spark, sf_dir):
    y = I.component(spark, sf_dir, 0)
    return _rounded(P.harmonic_extension(I.knn(spark, sf_dir), y.select("v", F.when(F.col("v") % 4 == 0, F.col("y")).alias("value")), method="weighted_mean"), 7)


@_register()
def tolerant_search(spark, sf_dir):
    g, y = I.knn(spark, sf_dir), I.component(spark, sf_dir, 0)
    return tolerant_basins(g, y, X.extrema_table(g, y))


@_register(
    _knn(
        f"SELECT step, coalesce((SELECT max(b.step) FROM st b WHERE b.step < a.step AND b.surviving = a.surviving), -surviving)::BIGINT AS left, coalesce((SELECT max(b.step) FROM st b WHERE b.step < a.step AND b.surviving = a.losing), -losing)::BIGINT AS right, {_r('(SELECT max(level) FROM st) - level')} AS height FROM st a",
        _MERGES + ",\nst AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY level DESC, plateau, losing)::INT AS step FROM event)",
        True,
    )
)
def dendrogram(spark, sf_dir):
    return _rounded(M.dendrogram(M.merge_tree(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), assign=False)[0]))


@_register(
    _knn(
        "SELECT level::INT AS level, parent, v, type, leaf FROM tr",
        _HOPS
        + _SPREAD
        + """,
low AS MATERIALIZED (SELECT v, type FROM idx WHERE hop_idx <= 2),
tr(v, type, level, parent, leaf) USING KEY (v, type) AS (SELECT v, type, 0, NULL::BIGINT, false FROM (SELECT * FROM low ORDER BY v LIMIT 1) UNION
  SELECT x.v, x.type, max(t.level) + 1, min(t.v), bool_and(low.v IS NULL) FROM tr t JOIN spread s ON s.extremum = t.v AND s.direction = t.type JOIN ext x ON x.v = s.v AND x.type <> t.type LEFT JOIN low ON low.v = x.v AND low.type = x.type
  LEFT JOIN recurring.tr r ON r.v = x.v AND r.type = x.type WHERE NOT t.leaf AND r.v IS NULL GROUP BY x.v, x.type)""",
        True,
    )
)
def spurious_tree(spark, sf_dir):
    g, y, m, _ = _basins(spark, sf_dir)
    e = X.extrema_table(g, y)
    low = X.classify_spurious(X.hop_index(g, y, e), "threshold", 2).filter("spurious").select("v", "type")
    root = low.orderBy("v").first()
    b = m.select(F.col("extremum"), F.col("direction").alias("type"), "v")
    return P.spurious_tree(root["v"] if root else 0, root["type"] if root else "max", b, low, e)


@_register()
def complex_tables(spark, sf_dir):
    return _rounded(basin_complex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), "superlevel_merge_tree", stages={"support": 3}).basins)


@_register(
    _knn(
        "SELECT m.v, m.direction, printf('basin_%s_v%08d', m.direction, m.extremum) AS basin_id, round(1.0 / count(*) OVER (PARTITION BY m.v, m.direction), 9) + 0.0 AS membership_weight, m.extremum = CASE m.direction WHEN 'max' THEN u.pt ELSE d.pt END AS is_primary "
        "FROM (SELECT DISTINCT p.pt AS v, 'max' AS direction, mx AS extremum FROM onpath p JOIN ends USING (v) UNION SELECT DISTINCT p.pt, 'min', mn FROM onpath p JOIN ends USING (v)) m JOIN up_end u ON u.v = m.v JOIN dn_end d ON d.v = m.v",
        _TRAJECTORIES,
        True,
    )
)
def complex_membership(spark, sf_dir):
    return _rounded(basin_complex(I.knn(spark, sf_dir), I.component(spark, sf_dir, 0), "trajectory_flow").membership)


@_register(
    "WITH RECURSIVE f AS (SELECT vec_id AS v, k, embedding[k + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS k)), p AS (SELECT v, substr(k::VARCHAR, 1, 1) || 'f' AS s, value, row_number() OVER (PARTITION BY v ORDER BY value DESC, k || '_f' || k) AS rank FROM f WHERE value > 0 QUALIFY rank <= 5), "
    "l AS MATERIALIZED (SELECT v, list(s ORDER BY rank) AS a, greatest(1, count(*) FILTER (value >= 1.0)) AS n FROM p GROUP BY v), "
    "g(v, n, k) AS (SELECT v, n, 0 FROM l UNION ALL SELECT v, CASE WHEN same > 1 AND n < z THEN n + 1 ELSE n END, k + 1 FROM (SELECT g.v, g.n, g.k, len(l.a) AS z, count(*) OVER (PARTITION BY array_to_string(l.a[1:g.n], '')) AS same FROM g JOIN l USING (v)) WHERE k < 5) "
    "SELECT v, array_to_string(a[1:g.n], '') AS label FROM g JOIN l USING (v) WHERE k = 5"
)
def feature_labels(spark, sf_dir):
    f = I.features(spark, sf_dir, range(64)).withColumn("feature", F.concat(F.expr("substring(feature, 2)"), F.lit("_"), F.col("feature")))
    return B.short_labels(B.profile(f, 5), 1.0)


# Pruning and comparison


@_register(
    _knn(
        "SELECT e.src, e.dst, round(e.len, 9) + 0.0 AS len FROM rk e JOIN mm ON mm.ref = e.src AND mm.v = e.dst, cutoff WHERE e.len < cutoff.len OR e.r <= mm.b",
        """,
rk AS MATERIALIZED (SELECT src, dst, len, row_number() OVER (ORDER BY len, src DESC, dst DESC) AS r FROM edges WHERE src < dst),
cutoff AS (SELECT len FROM rk ORDER BY len DESC LIMIT 1 OFFSET (SELECT floor(count(*) * 0.7)::INT FROM rk)),
either AS MATERIALIZED (SELECT src, dst, r FROM rk UNION ALL SELECT dst, src, r FROM rk),
mm(ref, v, b) USING KEY (ref, v) AS (SELECT v, v, 0 FROM vertices UNION SELECT m.ref, e.dst, min(greatest(m.b, e.r)) FROM mm m JOIN either e ON e.src = m.v LEFT JOIN recurring.mm o ON o.ref = m.ref AND o.v = e.dst WHERE o.b IS NULL OR greatest(m.b, e.r) < o.b GROUP BY m.ref, e.dst)""",
        True,
    )
)
def pruned_long_edges(spark, sf_dir):
    return _rounded(pruning.prune_long_edges(I.knn(spark, sf_dir), 0.7).edges.filter("src < dst"))


@_register(_knn("SELECT ref, v, round(dist, 9) + 0.0 AS dist FROM sp", _sp("vertices", "s.dist + e.len <= 2.2"), True))
def radius_neighbours(spark, sf_dir):
    g = I.knn(spark, sf_dir)
    return _rounded(pruning.radius_neighbours(g, g.vertices, 2.2))


def _shorter(spark, sf_dir):
    """The graph of nearest neighbours and the same without its longest edges, half a unit shorter."""
    from ..graph import Graph

    g = I.knn(spark, sf_dir)
    return g, Graph(g.vertices, g.edges.filter("len <= 1.2").withColumn("len", F.col("len") - 0.5))


_SHORTER = ",\ne2 AS MATERIALIZED (SELECT src, dst, len - 0.5 AS len FROM edges WHERE len <= 1.2)"


def _deg(edges: str) -> str:
    return f"(SELECT d, count(*) / (SELECT count(*) FROM vertices)::DOUBLE AS share FROM (SELECT v, count(dst) AS d FROM vertices LEFT JOIN {edges} ON src = v GROUP BY v) GROUP BY d)"


_JS = "coalesce(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) / 2 ELSE 0 END), 0.0)"


@_register(_knn(f"SELECT d::VARCHAR AS bin, {_r('share')} AS share FROM {_deg('edges')}"))
def degree_distribution(spark, sf_dir):
    return _rounded(C.degree_distribution(I.knn(spark, sf_dir)))


@_register(_path(f"SELECT size::VARCHAR AS bin, {_r('sum(size) / (SELECT count(*) FROM vertices)::DOUBLE')} AS share FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY size"))
def component_distribution(spark, sf_dir):
    return _rounded(C.component_distribution(I.orders_path(spark, sf_dir)))


@_register(_knn(f"SELECT least(a.label, b.label)::VARCHAR || '|' || greatest(a.label, b.label)::VARCHAR AS bin, {_r('count(*) / (SELECT count(*) FROM edges WHERE src < dst)::DOUBLE')} AS share FROM edges JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE src < dst GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1")))
def label_distribution(spark, sf_dir):
    return _rounded(C.label_distribution(I.knn(spark, sf_dir), I.labels(spark, sf_dir)))


@_register(_knn(f"SELECT {_r(_JS)} AS divergence FROM (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM {_deg('edges')} a FULL JOIN {_deg('e2')} b USING (d))", _SHORTER))
def degree_divergence(spark, sf_dir):
    one, two = _shorter(spark, sf_dir)
    return _rounded(C.divergence(C.degree_distribution(one), C.degree_distribution(two)))


@_register(
    _knn(
        f"SELECT {_r(_JS)} AS divergence FROM (SELECT coalesce(a.s, 0) AS p, coalesce(b.s, 0) AS q FROM (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM bin WHERE g = 1 GROUP BY k) a FULL JOIN (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM bin WHERE g = 2 GROUP BY k) b USING (k))",
        _SHORTER
        + """,
al AS (SELECT 1 AS g, len FROM edges WHERE src < dst UNION ALL SELECT 2, len FROM e2 WHERE src < dst),
bin AS MATERIALIZED (SELECT g, least(9, floor((len - lo) / (hi - lo) * 10)) AS k FROM al, (SELECT min(len) AS lo, max(len) AS hi FROM al))""",
    )
)
def length_divergence(spark, sf_dir):
    return _rounded(C.divergence(*C.length_distributions(*_shorter(spark, sf_dir), 10)))


@_register(_knn(f"SELECT {_r('sum(CASE WHEN a.len IS NULL OR b.len IS NULL THEN 2.0 ELSE 3.0 * abs(a.len - b.len) END)', 7)} AS distance FROM (SELECT * FROM edges WHERE src < dst) a FULL JOIN (SELECT * FROM e2 WHERE src < dst) b USING (src, dst)", _SHORTER))
def graph_edit_distance(spark, sf_dir):
    return _rounded(C.edit_distance(*_shorter(spark, sf_dir), 2.0, 3.0), 7)


@_register(_knn(f"SELECT count(*) AS clusters, {_r('sum(i / m - pow(d / m, 2))')} AS modularity FROM (SELECT a.label, count(*)::DOUBLE AS d, sum((a.label = b.label)::INT) AS i FROM edges JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY a.label), (SELECT count(*)::DOUBLE AS m FROM edges)"))
def label_modularity(spark, sf_dir):
    return _rounded(C.modularity(I.knn(spark, sf_dir), I.labels(spark, sf_dir)))


# Shared neighbours, the nerve, partitions, spectra and charts

_COVER = """,
cover AS MATERIALIZED (SELECT src AS v, dst AS x, len AS d FROM near UNION ALL SELECT v, v, 0.0 FROM vertices),
shared AS MATERIALIZED (SELECT a.v AS a, b.v AS b, min(a.d + b.d) AS len, count(*) AS common FROM cover a JOIN cover b ON a.x = b.x AND a.v < b.v GROUP BY 1, 2)"""

_TRIANGLES = """,
corners AS MATERIALIZED (SELECT DISTINCT a.v AS a, b.v AS b, c.v AS c FROM cover a JOIN cover b ON a.x = b.x AND a.v < b.v JOIN cover c ON c.x = b.x AND b.v < c.v),
sides AS (SELECT t.*, list_sort([p.len, q.len, r.len]) AS s FROM corners t JOIN shared p ON p.a = t.a AND p.b = t.b JOIN shared q ON q.a = t.a AND q.b = t.c JOIN shared r ON r.a = t.b AND r.b = t.c),
triangles AS MATERIALIZED (SELECT a, b, c, sqrt(greatest(0, h * (h - s[1]) * (h - s[2]) * (h - s[3]))) AS weight FROM (SELECT *, (s[1] + s[2] + s[3]) / 2 AS h FROM sides))"""


@_register(_knn(f"SELECT a.src AS a, a.dst AS b, {_r('a.len')} AS len FROM near a JOIN near b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst"))
def mutual_neighbours(spark, sf_dir):
    return _rounded(graphs.mutual_edges(I.near(spark, sf_dir)))


@_register(_knn(f"SELECT a, b, {_r('len')} AS len, common FROM shared", _COVER))
def shared_neighbours(spark, sf_dir):
    return _rounded(graphs.shared_edges(I.near(spark, sf_dir)))


@_register(
    _knn(
        f"SELECT 0 AS dim, v::VARCHAR AS simplex, 1.0 AS weight FROM vertices UNION ALL SELECT 1, a || '|' || b, {_r('len', 6)} FROM shared UNION ALL SELECT 2, a || '|' || b || '|' || c, {_r('weight', 6)} FROM triangles",
        _COVER + _TRIANGLES,
    )
)
def nerve_simplices(spark, sf_dir):
    s = N.nerve(I.near(spark, sf_dir))
    return _rounded(s.select("dim", F.concat_ws("|", F.col("vertices").cast("array<string>")).alias("simplex"), "weight"), 6)


@_register(
    _knn(
        "SELECT 0 AS dim, count(*) AS n FROM vertices UNION ALL SELECT 1, count(*) FROM shared UNION ALL SELECT 2, count(*) FROM triangles UNION ALL "
        "SELECT 3, count(*) FROM (SELECT DISTINCT a.v, b.v, c.v, d.v FROM cover a JOIN cover b ON a.x = b.x AND a.v < b.v JOIN cover c ON c.x = b.x AND b.v < c.v JOIN cover d ON d.x = c.x AND c.v < d.v)",
        _COVER + _TRIANGLES,
    )
)
def simplex_counts(spark, sf_dir):
    return N.nerve_counts(I.near(spark, sf_dir), 3)


@_register(
    _knn(
        f"SELECT count(*) AS edges, {_r('sum(e.len)', 7)} AS length FROM rk e JOIN mm ON mm.ref = e.src AND mm.v = e.dst WHERE e.r <= mm.b",
        """,
rk AS MATERIALIZED (SELECT src, dst, len, row_number() OVER (ORDER BY len, src DESC, dst DESC) AS r FROM edges WHERE src < dst),
either AS MATERIALIZED (SELECT src, dst, r FROM rk UNION ALL SELECT dst, src, r FROM rk),
mm(ref, v, b) USING KEY (ref, v) AS (SELECT v, v, 0 FROM vertices UNION SELECT m.ref, e.dst, min(greatest(m.b, e.r)) FROM mm m JOIN either e ON e.src = m.v LEFT JOIN recurring.mm o ON o.ref = m.ref AND o.v = e.dst WHERE o.b IS NULL OR greatest(m.b, e.r) < o.b GROUP BY m.ref, e.dst)""",
        True,
    )
)
def spanning_length(spark, sf_dir):
    tree = pruning.prune_long_edges(I.knn(spark, sf_dir), 1.0).edges.filter("src < dst")
    return _rounded(tree.agg(F.count("*").alias("edges"), F.sum("len").alias("length")), 7)


def _partitions(spark, sf_dir):
    """Three partitions of the vectors: by label, by the sign of a component, and by that of two."""
    e = I.table(spark, sf_dir, "embeddings")
    sign = lambda k: (F.col("embedding")[k] > 0).cast("int")
    cluster = F.explode(F.array(*(F.struct(F.lit(i).alias("run"), c.cast("long").alias("cluster")) for i, c in enumerate((F.col("label"), sign(0), sign(0) * 2 + sign(1))))))
    return e.select(F.col("vec_id").alias("v"), cluster.alias("p")).select("p.run", "v", "p.cluster")


_LIKE = """WITH p AS MATERIALIZED (SELECT 0 AS run, vec_id AS v, label::INT AS c FROM embeddings UNION ALL SELECT 1, vec_id, (embedding[1] > 0)::INT FROM embeddings UNION ALL SELECT 2, vec_id, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT FROM embeddings),
cells AS MATERIALIZED (SELECT x.run AS f, y.run AS s, x.c AS a, y.c AS b, count(*)::DOUBLE AS n FROM p x JOIN p y ON x.v = y.v AND x.run < y.run GROUP BY 1, 2, 3, 4),
c AS (SELECT f, s, sum(n) AS n, sum(n * (n - 1) / 2) AS k, sum(n * ln(n)) AS l FROM cells GROUP BY 1, 2),
a AS (SELECT f, s, sum(n * (n - 1) / 2) AS k, sum(n * ln(n)) AS l FROM (SELECT f, s, a, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT f, s, sum(n * (n - 1) / 2) AS k, sum(n * ln(n)) AS l FROM (SELECT f, s, b, sum(n) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT f AS first, s AS second, (c.k - a.k * b.k / (n * (n - 1) / 2)) / ((a.k + b.k) / 2 - a.k * b.k / (n * (n - 1) / 2)) AS r, 2 * (ln(n) + c.l / n - a.l / n - b.l / n) / (2 * ln(n) - a.l / n - b.l / n) AS nmi, (a.l + b.l - 2 * c.l) / n AS vi FROM c JOIN a USING (f, s) JOIN b USING (f, s))
"""


@_register(_LIKE + f"SELECT first, second, {_r('r')} AS adjusted_rand, {_r('nmi')} AS nmi, {_r('vi')} AS vi FROM q")
def partition_similarities(spark, sf_dir):
    return _rounded(clusters.similarities(_partitions(spark, sf_dir)))


@_register(_LIKE + f"SELECT run, {_r('avg(r)')} AS stability FROM (SELECT first AS run, r FROM q UNION ALL SELECT second, r FROM q UNION ALL SELECT unnest([0, 1, 2]), 1.0) GROUP BY run")
def consensus_partition(spark, sf_dir):
    return _rounded(clusters.consensus(_partitions(spark, sf_dir)))


@_register()
def communities(spark, sf_dir):
    return clusters.communities(I.knn(spark, sf_dir))


@_register()
def resolution_scan(spark, sf_dir):
    return _rounded(clusters.scan_resolutions(I.knn(spark, sf_dir), [0.5, 1.0, 2.0])[0])


@_register()
def laplacian_spectrum(spark, sf_dir):
    return _rounded(spectrum.eigenvectors(I.knn(spark, sf_dir), 5)[0], 6)


@_register()
def local_charts(spark, sf_dir):
    c = charts.local_charts(I.table(spark, sf_dir, "embeddings"), I.near(spark, sf_dir), share=0.9)
    return _rounded(c.select("v", "dim", "ratio", F.col("singular")[0].alias("largest")), 6)


@_register(
    f"""WITH o AS (SELECT o_orderkey, o_custkey, (o_orderkey % 97) / 97.0::DOUBLE AS x, o_totalprice / 100000.0 AS y, (1 + o_orderkey % 3)::DOUBLE AS w FROM orders),
m AS (SELECT o_custkey, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM o GROUP BY o_custkey),
s AS (SELECT o_custkey, sum(w * pow(x - mx, 2)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM o JOIN m USING (o_custkey) GROUP BY o_custkey),
j AS (SELECT o_orderkey, y, x, mx, my, CASE WHEN sxx > 1e-3 THEN sxy / sxx ELSE 0 END AS slope, w / sw + CASE WHEN sxx > 1e-3 THEN w * pow(x - mx, 2) / sxx ELSE 0 END AS h FROM o JOIN m USING (o_custkey) JOIN s USING (o_custkey))
SELECT o_orderkey, {_r("slope", 6)} AS slope, {_r("my + slope * (x - mx)", 6)} AS fitted, CASE WHEN 1 - h > 1e-3 THEN {_r("pow((y - my - slope * (x - mx)) / (1 - h), 2)", 5)} END AS loo_error FROM j"""
)
def weighted_lines(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    out = models.weighted_line(o, "o_custkey", k % 97 / 97.0, F.col("o_totalprice") / 100000.0, 1 + k % 3, 1e-3)
    return _rounded(out.select("o_orderkey", "slope", "fitted"), 6).join(_rounded(out.select("o_orderkey", "loo_error"), 5), "o_orderkey")


@_register("SELECT p_partkey, translate(p_name || ' (' || p_brand || '): ' || p_type || '/a''b*c+d, e', ' ,/():''*+', '___') AS name FROM part")
def standard_names(spark, sf_dir):
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): "), "p_type", F.lit("/a'b*c+d, e"))
    return I.table(spark, sf_dir, "part").select("p_partkey", scalars.standardised(text).alias("name"))


@_register(
    f"""WITH p AS (SELECT o_orderpriority AS level, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS k FROM orders GROUP BY 1), t AS (SELECT sum(n) AS m, sum(k) AS y FROM p),
e AS (SELECT *, n * y / m AS e FROM p, t)
SELECT level, n, k AS successes, {_r("k / n")} AS share, {_r("pow(abs(k - e) - least(0.5, abs(k - e)), 2) * (1 / e + 1 / (n - e) + 1 / (y - e) + 1 / (m - n - y + e))", 7)} AS chi_sq FROM e"""
)
def group_proportions(spark, sf_dir):
    p = stats.proportions(I.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "F")
    return _rounded(p.select("level", "n", "successes", "share"), 9).join(_rounded(p.select("level", "chi_sq"), 7), "level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
