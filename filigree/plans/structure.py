"""Registered queries of the tree code, of orderings and of the structure of graphs, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import elimination, factor, forces, graph, leastsquares, linalg, ordering, spatial, strong, treecode
from filigree.operators.state import discard, written
from filigree.plans import queries as base
from filigree.plans.queries import PJ, _attract_sql, _r, _round, _y_sql
from filigree.sources import matlab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# --- repulsion by a tree ---------------------------------------------------------------------------------------------
def _tree_sql(d: int, theta: float, leaf_points: int) -> str:
    """The tree over y(id, y0, ..) as tables of cells, the walk from the root as a recursion, and the sums as push(id, f0, .., zeta)."""
    depth, span = treecode.DEPTH, range(d)
    ys, gs = ", ".join(f"y{j}" for j in span), ", ".join(f"g{j}" for j in span)
    extent = "greatest(" + ", ".join(f"max(y{j}) - min(y{j})" for j in span) + ")" if d > 1 else "max(y0) - min(y0)"
    cells = ", ".join(f"least(floor((y{j} - m{j}) / extent * {1 << depth}), {(1 << depth) - 1})::BIGINT AS c{j}" for j in span)
    parent = " AND ".join(f"c.g{j} >> 1 = p.g{j}" for j in span)
    same = lambda a, b: " AND ".join([f"{a}.l = {b}.l", *(f"{a}.g{j} = {b}.g{j}" for j in span)])
    to = " AND ".join(["t.l = w.tl", *(f"t.g{j} = w.t{j}" for j in span)])
    side = "greatest(" + ", ".join(f"p.b{j} - p.a{j}" for j in span) + ")" if d > 1 else "p.b0 - p.a0"
    beside = [f"greatest(t.a{j} - p.x{j}, p.x{j} - t.b{j}, 0)" for j in span]
    far = f"({side} < {theta} * sqrt({' + '.join(f'{b} * {b}' for b in beside)}))"
    pair = "w.tl, " + ", ".join(f"w.t{j}" for j in span)
    r2 = " + ".join(f"(c.y{j} - s.x{j}) * (c.y{j} - s.x{j})" for j in span)
    return f"""ps AS (SELECT {ys}, count(*)::DOUBLE AS m FROM y GROUP BY {ys}),
ex AS (SELECT {", ".join(f"min(y{j}) AS m{j}" for j in span)}, {extent} AS extent FROM ps),
ce AS (SELECT {ys}, m, {cells} FROM ps, ex),
al AS (SELECT l, {", ".join(f"c{j} >> ({depth} - l) AS g{j}" for j in span)}, sum(m) AS n, count(*) AS k, {", ".join(f"sum(m * y{j}) / sum(m) AS x{j}, min(y{j}) AS a{j}, max(y{j}) AS b{j}" for j in span)} FROM ce, (SELECT unnest(range({depth + 1}))::INT AS l) GROUP BY l, {", ".join(f"c{j} >> ({depth} - l)" for j in span)}),
no AS (SELECT c.*, c.k > {leaf_points} AND c.l < {depth} AS opens FROM al c LEFT JOIN al p ON p.l = c.l - 1 AND {parent} WHERE c.l = 0 OR p.k > {leaf_points}),
le AS (SELECT * FROM no WHERE NOT opens),
wa(tl, {", ".join(f"t{j}" for j in span)}, l, {gs}) AS (SELECT t.l, {", ".join(f"t.g{j}" for j in span)}, s.l, {", ".join(f"s.g{j}" for j in span)} FROM le t, no s WHERE s.l = 0
 UNION ALL SELECT {pair}, c.l, {", ".join(f"c.g{j}" for j in span)} FROM wa w JOIN no p ON {same("p", "w")} JOIN le t ON {to} JOIN no c ON c.l = p.l + 1 AND {parent} WHERE p.opens AND NOT {far}),
me AS (SELECT {pair}, p.*, {far} AS is_far FROM wa w JOIN no p ON {same("p", "w")} JOIN le t ON {to}),
so AS (SELECT tl, {", ".join(f"t{j}" for j in span)}, n AS m, {", ".join(f"x{j}" for j in span)} FROM me WHERE is_far
 UNION ALL SELECT {pair}, q.m, {", ".join(f"q.y{j}" for j in span)} FROM me w JOIN ce q ON {" AND ".join(f"q.c{j} >> ({depth} - w.l) = w.g{j}" for j in span)} WHERE NOT w.is_far AND NOT w.opens),
su AS (SELECT {", ".join(f"c.y{j}" for j in span)}, c.m, sum(s.m / (1 + {r2})) AS s, {", ".join(f"sum(s.m * (c.y{j} - s.x{j}) / ((1 + {r2}) * (1 + {r2}))) AS h{j}" for j in span)} FROM so s JOIN ce c ON {" AND ".join(f"c.c{j} >> ({depth} - s.tl) = s.t{j}" for j in span)} GROUP BY {", ".join(f"c.y{j}" for j in span)}, c.m),
ze AS (SELECT sum(m * (s - 1)) AS zeta FROM su),
push AS (SELECT id, zeta, {", ".join(f"h{j} / zeta AS f{j}" for j in span)} FROM y JOIN su USING ({ys}), ze)"""


def _forces(df: DataFrame, d: int) -> DataFrame:
    return _round(_round(df, *[f"f{j}" for j in range(d)], digits=5, scale=1e4), "zeta", digits=3)


def _forces_sql(d: int) -> str:
    return f"SELECT id, {_r('zeta', 3)} AS zeta, " + ", ".join(f"{_r(f'f{j}', 5, 1e4)} AS f{j}" for j in range(d)) + " FROM push"


for _d, _theta in ((1, 0.5), (2, 0.5), (3, 0.7)):
    _add(f"repulse_tree_{_d}d", lambda spark, sf, d=_d, theta=_theta: _forces(treecode.repulse_tree(base.placed(base.parts(spark, sf), d), theta, 16), d), f"WITH RECURSIVE {_y_sql('part', 'p_partkey')}, {_tree_sql(_d, _theta, 16)} {_forces_sql(_d)}")
_add("repulse_tree_exact", lambda spark, sf: _forces(treecode.repulse_tree(base.placed(base.suppliers(spark, sf), 2), 0.0, 8), 2), f"WITH {_y_sql('supplier', 's_suppkey')}, {base._repulse_sql(2)} {_forces_sql(2)}")
_add("gradient_tree", lambda spark, sf: _round(forces.gradient(base.part_joint(spark, sf), base.placed(base.parts(spark, sf), 2), 12.0, theta=0.5).select("id", "d0", "d1"), "d0", "d1", digits=4, scale=1e4), f"WITH RECURSIVE {PJ}, {_y_sql('part', 'p_partkey')}, {_attract_sql(2)}, {_tree_sql(2, 0.5, treecode.LEAF_POINTS)} SELECT p.id, " + ", ".join(_r(f"12.0 * coalesce(a.f{j}, 0) - p.f{j}", 4, 1e4) + f" AS d{j}" for j in (0, 1)) + " FROM push p LEFT JOIN pull a USING (id)")


# --- graphs of customers and parts -----------------------------------------------------------------------------------
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """c, p, q: customer (even numbers) and part (odd numbers) of every line of an order, and its quantity."""
    orders = base._table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (2 * F.col("o_custkey")).alias("c"))
    return base._table(spark, sf, "lineitem").join(orders, "l_orderkey").select("c", (2 * F.col("l_partkey") + 1).alias("p"), F.col("l_quantity").alias("q"))


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    return base._table(spark, sf, "customer").select((2 * F.col("c_custkey")).alias("id")).unionByName(base.parts(spark, sf).select((2 * F.col("id") + 1).alias("id")))


def directed(spark: SparkSession, sf: str) -> DataFrame:
    """From customers to parts where the quantity is 49 or 50, back where it is 1 or 2."""
    rows = _lines(spark, sf)
    return rows.where("q >= 49").select(F.col("c").alias("src"), F.col("p").alias("dst")).unionByName(rows.where("q <= 2").select(F.col("p").alias("src"), F.col("c").alias("dst")))


def large_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers (src) and parts (dst) of the lines with the largest quantity."""
    return _lines(spark, sf).where("q >= 50").select(F.col("c").alias("src"), F.col("p").alias("dst")).distinct()


LI = "li AS (SELECT 2 * o_custkey AS c, 2 * l_partkey + 1 AS p, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
VE = "ve AS (SELECT 2 * c_custkey AS id FROM customer UNION ALL SELECT 2 * p_partkey + 1 FROM part)"
DI = f"{LI}, {VE}, di AS (SELECT DISTINCT c AS src, p AS dst FROM li WHERE q >= 49 UNION SELECT DISTINCT p, c FROM li WHERE q <= 2)"
BI = f"{LI}, {VE}, bi AS (SELECT DISTINCT c AS src, p AS dst FROM li WHERE q >= 50)"

_add(
    "strong_components",
    lambda spark, sf: strong.strong_components(directed(spark, sf), _ends(spark, sf)),
    f"WITH RECURSIVE {DI}, re AS (SELECT src AS a, dst AS b FROM di UNION SELECT a, dst FROM re JOIN di ON b = src) SELECT id, least(id, coalesce(m, id)) AS scc FROM ve LEFT JOIN (SELECT x.a, min(x.b) AS m FROM re x JOIN re y ON x.a = y.b AND x.b = y.a GROUP BY 1) ON id = a",
)

#: Components of the bipartite graph, and in each all sets of columns with their neighbours, as bits: by Hall's theorem a maximum
#: matching leaves free the greatest difference of the two sizes, and the sets that reach it are closed under union and section.
HALL = f"""{BI}, sy AS (SELECT src AS a, dst AS b FROM bi UNION ALL SELECT dst, src FROM bi),
re AS (SELECT a, a AS o FROM sy UNION SELECT re.a, b FROM re JOIN sy ON o = sy.a), co AS (SELECT a AS id, min(o) AS k FROM re GROUP BY 1),
cl AS (SELECT k, src, row_number() OVER (PARTITION BY k ORDER BY src) - 1 AS i FROM (SELECT DISTINCT k, src FROM bi JOIN co ON src = id)),
ro AS (SELECT k, dst, sum(1 << i) AS mask, row_number() OVER (PARTITION BY k ORDER BY dst) - 1 AS i FROM bi JOIN cl USING (src) GROUP BY k, dst),
su AS (SELECT k, unnest(range(1 << n)) AS s FROM (SELECT k, count(*) AS n FROM cl GROUP BY 1)),
ha AS (SELECT su.k, s, bit_count(s::BIGINT)::BIGINT AS size, count(*) FILTER ((mask::BIGINT & s) <> 0) AS around FROM su JOIN ro USING (k) GROUP BY 1, 2),
be AS (SELECT k, max(size - around) AS free FROM ha GROUP BY 1)"""

_add(
    "maximum_matching",
    lambda spark, sf: _matching_facts(large_lines(spark, sf)),
    f"WITH RECURSIVE {HALL}, nu AS (SELECT (SELECT count(*) FROM cl) - sum(free) AS n FROM be) SELECT n::BIGINT AS pairs, n::BIGINT AS columns, n::BIGINT AS rows, n::BIGINT AS edges FROM nu",
)
_add(
    "dulmage_mendelsohn",
    lambda spark, sf: _form(spark, sf),
    f"""WITH RECURSIVE {HALL}, ti AS (SELECT ha.k, s FROM ha JOIN be USING (k) WHERE size - around = free),
mi AS (SELECT k, bit_and(s::BIGINT) AS least_set, bit_or(s::BIGINT) AS most_set FROM ti GROUP BY 1),
ca AS (SELECT cl.k, src, cl.i, bit_and(s::BIGINT) AS own FROM cl JOIN ti ON ti.k = cl.k AND ((s >> cl.i) & 1) = 1 GROUP BY ALL),
ra AS (SELECT ro.k, dst, bit_and(s::BIGINT) AS own FROM ro JOIN ti ON ti.k = ro.k AND (mask::BIGINT & s) <> 0 GROUP BY ALL),
na AS (SELECT k, own, min(src) AS block FROM ca GROUP BY 1, 2),
cp AS (SELECT src AS id, 'column' AS side, CASE WHEN (least_set >> cl.i) & 1 = 1 THEN 'wide' WHEN (most_set >> cl.i) & 1 = 0 THEN 'tall' ELSE 'square' END AS part, block FROM cl JOIN mi USING (k) LEFT JOIN ca USING (k, src) LEFT JOIN na USING (k, own)),
rp AS (SELECT dst AS id, 'row' AS side, CASE WHEN mask::BIGINT & least_set <> 0 THEN 'wide' WHEN mask::BIGINT & most_set = 0 THEN 'tall' ELSE 'square' END AS part, block FROM ro JOIN mi USING (k) LEFT JOIN ra USING (k, dst) LEFT JOIN na USING (k, own)),
al AS (SELECT * FROM cp UNION ALL SELECT * FROM rp)
SELECT id, CASE WHEN id % 2 = 0 THEN 'column' ELSE 'row' END AS side, coalesce(part, CASE WHEN id % 2 = 0 THEN 'wide' ELSE 'tall' END) AS part, CASE WHEN part = 'square' THEN block ELSE -1 END AS block FROM ve LEFT JOIN al USING (id)""",
)


def _matching_facts(edges: DataFrame) -> DataFrame:
    """Pairs, distinct columns and rows of them, and how many are edges."""
    pairs = strong.maximum_matching(edges)
    there = pairs.join(edges.withColumn("there", F.lit(1)), ["src", "dst"], "left")
    return there.agg(F.count("*").alias("pairs"), F.countDistinct("src").alias("columns"), F.countDistinct("dst").alias("rows"), F.count("there").alias("edges"))


def _form(spark: SparkSession, sf: str) -> DataFrame:
    ends = _ends(spark, sf)
    return strong.dulmage_mendelsohn(large_lines(spark, sf), ends.where("id % 2 = 0"), ends.where("id % 2 = 1")).fillna(-1)


# --- orderings and elimination ---------------------------------------------------------------------------------------
#: Vertices of a part that the queries still dissect over tables, and rows of the mesh of parts.
_PART, _WIDTH = 1024, 40


def _mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ids = base.parts(spark, sf)
    return ordering.mesh(ids, _WIDTH), ids


def _filled(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return elimination.column_counts(edges, vertices).agg((F.sum("n") - F.count("*")).alias("filled"))


def _dissection_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices, distinct positions and the last one, edges across a cut, entries below the diagonal of the natural order's
    factor, and whether the dissection's has fewer (where there is a cut over tables)."""
    edges, ids = _mesh(spark, sf)
    own = written(ordering.nested_dissection(edges, ids, _PART), "ordering")
    moved = graph.relabel(edges, own.select(F.col("id").alias("old"), F.col("position").alias("new")))
    facts = own.agg(F.count("*").alias("n"), F.countDistinct("position").alias("positions"), F.max("position").alias("last"))
    crossing = ordering.crossing(edges, own).agg(F.count("*").alias("crossing"))
    natural = _filled(edges, ids)
    less = _filled(moved, own.select(F.col("position").alias("id"))).withColumnRenamed("filled", "ordered")
    out = facts.crossJoin(crossing).crossJoin(natural).crossJoin(less)  # one row each
    return out.select("n", "positions", "last", "crossing", "filled", ((F.col("ordered") < F.col("filled")) | (F.col("n") <= _PART)).cast("int").alias("better"))


ME = f"me AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE (p_partkey + 1) % {_WIDTH} <> 0 UNION ALL SELECT p_partkey, p_partkey + {_WIDTH} FROM part), ms AS (SELECT a, b FROM me WHERE b IN (SELECT p_partkey FROM part)), sy AS (SELECT a, b FROM ms UNION ALL SELECT b, a FROM ms)"
#: The factor's entries: (j, i) is one where a way from j to i > j goes through vertices below j alone.
FACTOR = "wy AS (SELECT a AS j, a AS o FROM sy UNION SELECT j, b FROM wy JOIN sy ON o = a WHERE b < j), fa AS (SELECT DISTINCT j, b AS i FROM wy JOIN sy ON o = a WHERE b > j)"

_add("nested_dissection", lambda spark, sf: ordering.nested_dissection(*_mesh(spark, sf), _PART))
_add("dissection_facts", _dissection_facts, f"WITH RECURSIVE {ME}, {FACTOR} SELECT count(*) AS n, count(*) AS positions, max(p_partkey) AS last, 0::BIGINT AS crossing, (SELECT count(*) FROM fa) AS filled, 1 AS better FROM part")
SB = f"{LI}, {VE}, sy AS (SELECT DISTINCT c AS a, p AS b FROM li WHERE q >= 49 UNION SELECT DISTINCT p, c FROM li WHERE q >= 49)"
_large = lambda spark, sf: directed(spark, sf).where("src % 2 = 0")
_add("elimination_tree", lambda spark, sf: elimination.tree(_large(spark, sf), _ends(spark, sf)).fillna(-1), f"WITH RECURSIVE {SB}, {FACTOR} SELECT id, coalesce(min(i), -1) AS parent FROM ve LEFT JOIN fa ON id = j GROUP BY id")
_add("column_counts", lambda spark, sf: elimination.column_counts(_large(spark, sf), _ends(spark, sf)), f"WITH RECURSIVE {SB}, {FACTOR} SELECT id, count(i) + 1 AS n FROM ve LEFT JOIN fa ON id = j GROUP BY id")


# --- factors and solutions -------------------------------------------------------------------------------------------
def _system(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shifted Laplacian of the mesh of parts, its vertices, and the right side that belongs to sin(1.7 id)."""
    edges, ids = _mesh(spark, sf)
    matrix = factor.laplacian(edges, ids)
    return matrix, ids, linalg.spmv(matrix, ids.select("id", F.sin(1.7 * F.col("id")).alias("x")))


def _product(spark: SparkSession, sf: str) -> DataFrame:
    matrix, ids, _ = _system(spark, sf)
    low = factor.lower_edges(factor.cholesky(matrix, ids))
    whole = linalg.spgemm(low, graph.transpose(low))  # L L'
    return _round(whole, "w", digits=8).where("w <> 0")


def _solution(spark: SparkSession, sf: str) -> DataFrame:
    matrix, ids, b = _system(spark, sf)
    return _round(factor.solve(factor.cholesky(matrix, ids), b), "x", digits=8)


LA = f"{ME}, la AS (SELECT a AS src, b AS dst, -1.0 AS w FROM sy UNION ALL SELECT p_partkey, p_partkey, 1.0 + (SELECT count(*) FROM sy WHERE a = p_partkey) FROM part)"
_add("cholesky_product", _product, f"WITH {LA} SELECT src, dst, {_r('w', 8)} AS w FROM la")
_add("cholesky_solve", _solution, f"SELECT p_partkey AS id, {_r('sin(1.7 * p_partkey)', 8)} AS x FROM part")


# --- grids of more cells ---------------------------------------------------------------------------------------------
#: Dimensions, step and the cells a side that follow from it, and whether planes of the grid are convolved apart.
for _name, _d, _step, _n, _planes in (("repulse_grid_26_2d", 2, 0.08, 26, False), ("repulse_planes_2d", 2, 0.08, 26, True), ("repulse_planes_3d", 3, 0.12, 18, True)):
    _add(
        _name,
        lambda spark, sf, d=_d, step=_step, planes=_planes: _forces(forces.repulse_grid(base.placed(base.suppliers(spark, sf), d), step, by_planes=planes), d),
        f"WITH {_y_sql('supplier', 's_suppkey')}, {base._grid_sql(_d, n=_n)}, push AS (SELECT id, zeta, " + ", ".join(f"(z{k} * phi0 - phi{k + 1}) / zeta AS f{k}" for k in range(_d)) + f" FROM po, ze) {_forces_sql(_d)}",
    )


# --- blocks by a tree over space -------------------------------------------------------------------------------------
#: Positions of a leaf, and the blocks in SQL: the tree's leaves, small ones under their parent, by the cells' numbers in each dimension.
_LEAF = 24
_SMALL = f"(l > 0 AND 4 * k <= {_LEAF})"
BK = f"""{_tree_sql(2, 0.5, _LEAF).split(", le AS")[0].split("le AS")[0].rstrip().rstrip(",")},
lf AS (SELECT l, g0, g1, {_SMALL} AS merged FROM no WHERE NOT opens),
bk AS (SELECT id, l - merged::INT AS level, g0 >> merged::INT AS g0, g1 >> merged::INT AS g1, merged FROM y JOIN ce USING (y0, y1) JOIN lf ON c0 >> ({treecode.DEPTH} - l) = g0 AND c1 >> ({treecode.DEPTH} - l) = g1)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.blocks(base.placed(base.parts(spark, sf), 2), _LEAF)


def _unwoven(cell: str, k: int) -> F.Column:
    """The bits of one dimension in a cell's code."""
    return sum((F.shiftleft(F.shiftright(cell, 2 * b + k).bitwiseAND(F.lit(1).cast("long")), b) for b in range(treecode.DEPTH)), F.lit(0).cast("long"))


_add("spatial_blocks", lambda spark, sf: _blocks(spark, sf).select("id", "level", _unwoven("cell", 0).alias("g0"), _unwoven("cell", 1).alias("g1"), "merged"), f"WITH {_y_sql('part', 'p_partkey')}, {BK} SELECT id, level, g0, g1, merged FROM bk")
_add("spatial_order", lambda spark, sf: spatial.spatial_order(base.placed(base.parts(spark, sf), 2), _LEAF))
_add(
    "block_pairs",
    lambda spark, sf: spatial.block_pairs(base.bought_together(spark, sf), _blocks(spark, sf)).select("src_level", _unwoven("src_cell", 0).alias("src_g0"), _unwoven("src_cell", 1).alias("src_g1"), "src_merged", "dst_level", _unwoven("dst_cell", 0).alias("dst_g0"), _unwoven("dst_cell", 1).alias("dst_g1"), "dst_merged", "nnz"),
    f"WITH {base.CO}, {_y_sql('part', 'p_partkey')}, {BK} SELECT "
    + ", ".join(f"{t}.{x} AS {c}_{x}" for t, c in (("a", "src"), ("b", "dst")) for x in ("level", "g0", "g1", "merged"))
    + ", count(*) AS nnz FROM co JOIN bk a ON src = a.id JOIN bk b ON dst = b.id GROUP BY ALL",
)


# --- least squares ---------------------------------------------------------------------------------------------------
def _gram(spark: SparkSession, sf: str) -> DataFrame:
    """R'R of the embeddings, which is their Gram matrix."""
    r = leastsquares.tall_factor(base.points(spark, sf))
    whole = r.T @ r
    return _round(spark.createDataFrame([(i, j, float(whole[i, j])) for i in range(len(r)) for j in range(len(r))], "i long, j long, v double"), "v")


def _dense_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.points(spark, sf).withColumn("y", F.aggregate(F.transform("x", lambda v, k: v * F.sin(k + 1.0)), F.lit(0.0), lambda s, v: s + v))
    c = leastsquares.fit_dense(rows)
    return _round(spark.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "k long, c double"), "c")


def _sparse_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A tall matrix: the shifted Laplacian of the mesh, and below it the identity; the right side is that of sin(1.7 id)."""
    edges, ids = _mesh(spark, sf)
    matrix = factor.laplacian(edges, ids, 8.0).unionByName(ids.select(F.col("id").alias("src"), (-1 - F.col("id")).alias("dst"), F.lit(1.0).alias("w")))
    matrix = written(matrix, "system")
    return _round(leastsquares.fit_sparse(matrix, linalg.spmv(matrix, ids.select("id", F.sin(1.7 * F.col("id")).alias("x"))), 1e-12), "x", digits=5)


_add("tall_factor", _gram, f"WITH pt AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT a.k AS i, b.k AS j, {_r('sum(a.v * b.v)')} AS v FROM pt a JOIN pt b USING (id) GROUP BY 1, 2")
_add("fit_dense", _dense_fit, f"SELECT k, {_r('sin(k + 1.0)')} AS c FROM (SELECT DISTINCT generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
_add("fit_sparse", _sparse_fit, f"SELECT p_partkey AS id, {_r('sin(1.7 * p_partkey)', 5)} AS x FROM part")


# --- sparse matrices of MATLAB files ---------------------------------------------------------------------------------
def _mat_sparse(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """Customers and parts through a sparse matrix inside a structure."""
    rows = written(base.bought(spark, sf), "bought")
    matlab.write_mat_sparse(rows, path, "graph.bought")
    discard(rows)
    return matlab.read_mat_sparse(spark, path, "graph.bought")


base._file_query("file_mat_sparse", "sparse.mat")(_mat_sparse, f"WITH {base.BU} SELECT * FROM bu")
