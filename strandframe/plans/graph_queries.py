"""Graph reductions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.operators import condensed, coverage, graph
from strandframe.plans.column_queries import _loc
from strandframe.plans.views import EDGES, LEN, OV, READS, SIDES, edges, overlaps, reads
from strandframe.session import cut, table


def graph_string_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored edges of proper overlaps."""
    return graph.string_edges(overlaps(spark, sf_dir), 100)


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


def graph_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with their mirrors."""
    return graph.mirrored(edges(spark, sf_dir))


def graph_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive edges."""
    return graph.transitive(graph.mirrored(edges(spark, sf_dir)), 500)


def graph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat edges."""
    return graph.repeats(graph.mirrored(edges(spark, sf_dir)))


def graph_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are not the best on a side."""
    return graph.best(graph.mirrored(edges(spark, sf_dir)), [F.col("score"), F.col("len")])


def graph_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nodes that lead to each other."""
    return graph.loops(graph.mirrored(edges(spark, sf_dir)))


def graph_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges by score."""
    df = table(spark, sf_dir, "graph_edges").select("edge_id", "in_node", "out_node", "score").distinct().where("in_node is not null and out_node is not null")
    return graph.duplicates(df, [F.col("score").desc_nulls_last(), F.col("edge_id")]).select("edge_id", "score", "rank")


def graph_unreliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges weak on both sides."""
    return graph.unreliable(graph.mirrored(edges(spark, sf_dir)), "score", 0.6)


def graph_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways out of forks beyond what the coverage of their read calls for."""
    names = reads(spark, sf_dir).where("name is not null").select(F.col("read_id").cast("string").alias("read"), "name")
    cover = coverage.covers(overlaps(spark, sf_dir)).join(names, "read").select(F.col("name").alias("read"), "least", "middle")
    return graph.uncovered(graph.mirrored(edges(spark, sf_dir)), cover, 1000, 0.66, 1.2)


def graph_best_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are not the best on a side by alleles, score and identity."""
    df = table(spark, sf_dir, "graph_edges").where("in_node is not null and out_node is not null and in_node != out_node")
    snp = F.coalesce("snp_same", F.lit(0)) - 2 * F.coalesce("snp_diff", F.lit(0))
    e = df.groupBy("in_node", "out_node").agg(F.max(snp).alias("snp"), F.max("score").alias("score"), F.max("identity_pct").alias("identity"))
    return graph.best(graph.mirrored(e), [F.col("snp"), F.col("score"), F.col("identity")])


def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of low identity, with a way out left to every node."""
    df = table(spark, sf_dir, "graph_edges").where("in_node is not null and out_node is not null and in_node != out_node and identity_pct is not null")
    q = graph.mirrored(df.groupBy("in_node", "out_node").agg(F.max("identity_pct").alias("quality")))
    return graph.low_quality(q, "quality", graph.data_threshold(q, "quality"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(graph.mirrored(edges(spark, sf_dir)))
    return graph.simplify(e, "transitive:fuzz=500|best")[0]


def graph_spurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short dead ends of the cleaned graph."""
    return graph.spurs(_clean(spark, sf_dir), 3, 2_000)


def graph_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by unbranched path and place."""
    return graph.unitigs(_clean(spark, sf_dir))


def graph_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of unbranched paths."""
    e = _clean(spark, sf_dir)
    return graph.condensed(e, graph.unitigs(e))


def graph_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three steps of the contigs' ends."""
    names = table(spark, sf_dir, "contigs").select(F.explode(F.array(F.concat("ctg_name", F.lit(":B")), F.concat("ctg_name", F.lit(":E")))).alias("node"))
    return graph.neighbourhood(edges(spark, sf_dir), names, 3)


def graph_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the step that reduced them."""
    e = graph.mirrored(edges(spark, sf_dir))
    return graph.simplify(e, "transitive:fuzz=500|unreliable:r=0.5|best")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mirrored(edges(spark, sf_dir))


def path_spurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tips shorter by half than another way into their node."""
    return condensed.tips(_mirrored(spark, sf_dir))


def path_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead ends at forks with a branch twice as long."""
    return condensed.semi(_mirrored(spark, sf_dir))


def path_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between a fork and a join that are both better served."""
    return condensed.bridges(_mirrored(spark, sf_dir), 1.5)


def path_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of two ways with the scores of both pairings."""
    return condensed.crossings(_thin(spark, sf_dir))


def path_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel paths of one or two edges, but for the best."""
    return condensed.duplicates(_thin(spark, sf_dir))


def path_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weaker of two edges that lead to each other."""
    return condensed.back_edges(_mirrored(spark, sf_dir))


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best edges out of every node, and their mirrors."""
    m = _mirrored(spark, sf_dir)
    w = Window.partitionBy("in_node").orderBy(F.col("score").desc_nulls_last(), F.col("out_node"))
    return graph.mirrored(m.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r"))


def path_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected clusters of reads of the cleaned graph."""
    return condensed.clusters(_clean(spark, sf_dir))


def path_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superbubbles of the thinned graph."""
    return condensed.bubbles(_thin(spark, sf_dir))


def path_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge-disjoint and shortest paths through the superbubbles."""
    return condensed.flows(_thin(spark, sf_dir))


def path_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig paths by best edges over the simplified condensed graph."""
    return condensed.contig_paths(condensed.simplify(_clean(spark, sf_dir))[0])


QUERIES = {f.__name__: f for f in (graph_uncovered, graph_best_alleles, path_spurs, path_semi, path_bridges, path_crossings, path_duplicates, path_loops, path_clusters, path_bubbles, path_flows, path_contigs, graph_string_edges, graph_degrees, graph_mirrored, graph_transitive, graph_repeats, graph_best, graph_loops, graph_duplicates, graph_unreliable, graph_quality, graph_spurs, graph_unitigs, graph_condensed, graph_near, graph_simplified)}


def _rev(x: str) -> str:
    return f"(left({x}, length({x}) - 1) || CASE WHEN {x} LIKE '%B' THEN 'E' ELSE 'B' END)"


_M = f"{EDGES}, m AS (SELECT in_node, out_node, max(len) AS len, max(score) AS score FROM (SELECT * FROM edges UNION ALL SELECT {_rev('out_node')}, {_rev('in_node')}, len, score FROM edges) GROUP BY in_node, out_node)"


def _both(q: str, reason: str) -> str:
    return f"SELECT DISTINCT in_node, out_node, '{reason}' AS reason FROM (SELECT in_node, out_node FROM ({q}) UNION ALL SELECT {_rev('out_node')}, {_rev('in_node')} FROM ({q}))"


def _trans(t: str, fuzz: int) -> str:
    return f"SELECT z.in_node, z.out_node FROM {t} z JOIN {t} a ON a.in_node = z.in_node JOIN {t} b ON b.in_node = a.out_node AND b.out_node = z.out_node WHERE abs(z.len - a.len - b.len) <= {fuzz} AND a.out_node <> z.out_node"


def _best(t: str, order: str) -> str:
    top = f"SELECT in_node, out_node FROM (SELECT *, row_number() OVER (PARTITION BY in_node ORDER BY {order}, out_node DESC) AS rn FROM {t}) WHERE rn = 1"
    return f"SELECT in_node, out_node FROM {t} EXCEPT (SELECT in_node, out_node FROM ({top}) UNION SELECT {_rev('out_node')}, {_rev('in_node')} FROM ({top}))"


_UNREL = "SELECT in_node, out_node FROM (SELECT *, max(score) OVER (PARTITION BY in_node) AS o, max(score) OVER (PARTITION BY out_node) AS i FROM {0}) WHERE score < o * {1}::DOUBLE AND score < i * {1}::DOUBLE"
_DEG = "d AS (SELECT node, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT in_node AS node, 1 AS o, 0 AS i FROM m UNION ALL SELECT out_node, 0, 1 FROM m) GROUP BY node)"
_CLEAN = f"t AS MATERIALIZED (SELECT in_node, out_node FROM ({_both(_trans('m', 500), 't')})), m1 AS MATERIALIZED (SELECT m.* FROM m ANTI JOIN t USING (in_node, out_node)), b AS MATERIALIZED (SELECT in_node, out_node FROM ({_both(_best('m1', 'score DESC NULLS LAST'), 'b')})), g AS MATERIALIZED (SELECT m1.* FROM m1 ANTI JOIN b USING (in_node, out_node))"
_LINE = """dg AS (SELECT node, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT in_node AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT out_node, 0, 1 FROM g) GROUP BY node), inner_ AS (SELECT node FROM dg WHERE n_out = 1 AND n_in = 1),
    w AS (SELECT in_node, out_node, in_node || '>' || out_node AS unitig, 0 AS place, len, score FROM g WHERE in_node NOT IN (SELECT node FROM inner_) UNION ALL SELECT g.in_node, g.out_node, w.unitig, w.place + 1, g.len, g.score FROM w JOIN g ON g.in_node = w.out_node WHERE g.in_node IN (SELECT node FROM inner_)),
    ring AS (SELECT * FROM g ANTI JOIN w USING (in_node, out_node)), reach AS (SELECT in_node || '>' || out_node AS e, in_node || '>' || out_node AS x, out_node AS at FROM ring UNION SELECT r.e, g.in_node || '>' || g.out_node, g.out_node FROM reach r JOIN ring g ON g.in_node = r.at),
    low AS (SELECT e, min(x) AS unitig FROM reach GROUP BY e), rw AS (SELECT in_node, out_node, unitig, 0 AS place, len, score FROM ring JOIN low ON e = in_node || '>' || out_node WHERE e = unitig UNION ALL SELECT g.in_node, g.out_node, r.unitig, r.place + 1, g.len, g.score FROM rw r JOIN ring g ON g.in_node = r.out_node WHERE g.in_node || '>' || g.out_node <> r.unitig),
    u AS (SELECT * FROM w UNION ALL SELECT * FROM rw)"""

_THIN = f"th AS (SELECT in_node, out_node, len, score FROM (SELECT *, row_number() OVER (PARTITION BY in_node ORDER BY score DESC NULLS LAST, out_node) AS rn FROM m) WHERE rn <= 2), k AS (SELECT in_node, out_node, max(len) AS len, max(score) AS score FROM (SELECT * FROM th UNION ALL SELECT {_rev('out_node')}, {_rev('in_node')}, len, score FROM th) GROUP BY in_node, out_node)"
_DEGK = _DEG.replace("FROM m", "FROM k")

SQL = {
    "graph_best_alleles": f"""WITH r AS (SELECT in_node, out_node, max(coalesce(snp_same, 0) - 2 * coalesce(snp_diff, 0)) AS snp, max(score) AS score, max(identity_pct) AS identity FROM graph_edges WHERE in_node IS NOT NULL AND out_node IS NOT NULL AND in_node <> out_node GROUP BY in_node, out_node),
        m AS (SELECT in_node, out_node, max(snp) AS snp, max(score) AS score, max(identity) AS identity FROM (SELECT * FROM r UNION ALL SELECT {_rev('out_node')}, {_rev('in_node')}, snp, score, identity FROM r) GROUP BY in_node, out_node)
        {_both(_best('m', 'snp DESC NULLS LAST, score DESC NULLS LAST, identity DESC NULLS LAST'), 'best')}""",
    "graph_uncovered": f"""WITH RECURSIVE {OV}, {SIDES}, {READS}, {_M}, iv AS (SELECT read, CAST(r_start AS BIGINT) AS s, CAST(r_end AS BIGINT) AS e, CAST(r_len AS BIGINT) AS l FROM sides),
        ev AS (SELECT read, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT read, s AS pos, 1 AS d FROM iv WHERE s < e UNION ALL SELECT read, e, -1 FROM iv WHERE s < e UNION ALL SELECT read, 0, 0 FROM iv WHERE l IS NOT NULL UNION ALL SELECT read, l, 0 FROM iv WHERE l IS NOT NULL) GROUP BY read, pos),
        sg AS (SELECT * FROM (SELECT read, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY read ORDER BY pos)) WHERE "end" IS NOT NULL), sl AS (SELECT *, max("end") OVER (PARTITION BY read) // 3 AS t FROM sg),
        th AS (SELECT read, CAST(sum(depth * greatest(0, least("end", t) - start)) AS BIGINT) // nullif(max(t), 0) AS c0, CAST(sum(depth * greatest(0, least("end", 2 * t) - greatest(start, t))) AS BIGINT) // nullif(max(t), 0) AS c1, CAST(sum(depth * greatest(0, "end" - greatest(start, 2 * t))) AS BIGINT) // nullif(max(t), 0) AS c2 FROM sl GROUP BY read),
        cv AS (SELECT name, max(least(c0, c1, c2)) AS least, max(c1) AS middle FROM th JOIN reads ON read_id = read WHERE name IS NOT NULL GROUP BY name), fk AS (SELECT in_node FROM m GROUP BY in_node HAVING count(*) > 1),
        w AS (SELECT m.in_node, m.out_node, coalesce(m.score, 0) AS s, coalesce(o.least, 0) AS least, i.middle * 1.2::DOUBLE AS most, row_number() OVER (PARTITION BY m.in_node ORDER BY coalesce(m.score, 0) DESC, m.out_node) AS k FROM m JOIN fk ON fk.in_node = m.in_node LEFT JOIN cv i ON i.name = left(m.in_node, length(m.in_node) - 2) LEFT JOIN cv o ON o.name = left(m.out_node, length(m.out_node) - 2)),
        g AS (SELECT in_node, out_node, k, FALSE AS fall, CAST(least AS BIGINT) AS kept, CAST(s AS BIGINT) AS best FROM w WHERE k = 1
            UNION ALL SELECT in_node, out_node, k, fall, CASE WHEN fall THEN kept ELSE kept + least END, CASE WHEN fall THEN best ELSE greatest(best, s) END FROM (SELECT w.*, g.kept, g.best, (w.s < 1000 AND w.s < g.best * 0.66::DOUBLE) OR (g.kept <> 0 AND coalesce(g.kept + w.least > w.most, FALSE)) AS fall FROM g JOIN w ON w.in_node = g.in_node AND w.k = g.k + 1))
        {_both('SELECT in_node, out_node FROM g WHERE fall', 'unreliable')}""",
    "graph_simplified": f"""WITH {_M}, t AS MATERIALIZED (SELECT in_node, out_node FROM ({_both(_trans('m', 500), 't')}) SEMI JOIN m USING (in_node, out_node)), m1 AS MATERIALIZED (SELECT m.* FROM m ANTI JOIN t USING (in_node, out_node)), ur AS MATERIALIZED (SELECT in_node, out_node FROM ({_both(_UNREL.format('m1', 0.5), 'u')}) SEMI JOIN m1 USING (in_node, out_node)),
        m2 AS MATERIALIZED (SELECT m1.* FROM m1 ANTI JOIN ur USING (in_node, out_node)), bt AS (SELECT in_node, out_node FROM ({_both(_best('m2', 'score DESC NULLS LAST'), 'b')}) SEMI JOIN m2 USING (in_node, out_node))
        SELECT 'transitive' AS reason, count(*) AS n FROM t UNION ALL SELECT 'unreliable', count(*) FROM ur UNION ALL SELECT 'best', count(*) FROM bt""",
    "path_spurs": f"WITH {_M}, {_DEG}, t AS (SELECT m.*, max(len) OVER (PARTITION BY out_node) AS top FROM m) {_both('SELECT in_node, out_node FROM t JOIN d ON node = in_node WHERE n_in = 0 AND n_out = 1 AND len * 2 <= top', 'spur')}",
    "path_semi": f"""WITH {_M}, {_DEG}, o AS (SELECT in_node AS w, max(len) AS n FROM m GROUP BY in_node), t AS (SELECT m.*, max(len + coalesce(n, 0)) OVER (PARTITION BY in_node) AS top, count(*) OVER (PARTITION BY in_node) AS ways FROM m LEFT JOIN o ON w = out_node)
        {_both('SELECT in_node, out_node FROM t JOIN d ON node = out_node WHERE ways > 1 AND n_out = 0 AND n_in = 1 AND len * 2 <= top', 'semi')}""",
    "path_bridges": f"""WITH {_M}, x AS (SELECT * FROM m WHERE score IS NOT NULL), y AS (SELECT x.in_node, x.out_node, x.score, (SELECT max(o.score) FROM x o WHERE o.in_node = x.in_node AND o.out_node <> x.out_node) AS o, (SELECT max(i.score) FROM x i WHERE i.out_node = x.out_node AND i.in_node <> x.in_node) AS i FROM x)
        {_both('SELECT in_node, out_node FROM y WHERE o >= score * 1.5::DOUBLE AND i >= score * 1.5::DOUBLE', 'bridge')}""",
    "path_crossings": f"""WITH {_M}, {_THIN}, o AS (SELECT in_node, min(out_node) AS x, max(out_node) AS y FROM k GROUP BY in_node HAVING count(*) = 2), i AS (SELECT out_node, min(in_node) AS a, max(in_node) AS b FROM k GROUP BY out_node HAVING count(*) = 2)
        SELECT a, b, x, y, CAST(sum(CASE WHEN (in_node = a) = (out_node = x) THEN coalesce(score, 0) ELSE 0 END) AS BIGINT) AS straight, CAST(sum(CASE WHEN (in_node = a) = (out_node = x) THEN 0 ELSE coalesce(score, 0) END) AS BIGINT) AS crossed
        FROM k JOIN o USING (in_node) JOIN i USING (out_node) GROUP BY a, b, x, y HAVING count(*) = 4""",
    "path_duplicates": f"""WITH {_M}, {_THIN}, {_DEGK}, p AS (SELECT in_node, out_node, NULL AS node, len, score FROM k UNION ALL SELECT f.in_node, s.out_node, f.out_node, f.len + s.len, least(f.score, s.score) FROM k f JOIN d ON d.node = f.out_node AND n_in = 1 AND n_out = 1 JOIN k s ON s.in_node = f.out_node WHERE f.in_node <> s.out_node),
        gd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY in_node, out_node ORDER BY score DESC NULLS LAST, len DESC, node NULLS FIRST) AS rn FROM p) WHERE rn > 1), ge AS (SELECT in_node, coalesce(node, out_node) AS out_node FROM gd UNION SELECT node, out_node FROM gd WHERE node IS NOT NULL) {_both("SELECT * FROM ge", "duplicate")}""",
    "path_loops": f"WITH {_M}, l AS (SELECT x.in_node AS u, x.out_node AS v, coalesce(x.score, 0) AS s, coalesce(y.score, 0) AS t FROM m x JOIN m y ON x.in_node = y.out_node AND x.out_node = y.in_node WHERE x.in_node < x.out_node) {_both('SELECT CASE WHEN s >= t THEN v ELSE u END AS in_node, CASE WHEN s >= t THEN u ELSE v END AS out_node FROM l', 'loop')}",
    "path_clusters": f"""WITH RECURSIVE {_M}, {_CLEAN}, n AS (SELECT DISTINCT left(in_node, length(in_node) - 2) AS u, left(out_node, length(out_node) - 2) AS v FROM g), bb AS (SELECT u, v FROM n UNION SELECT v, u FROM n), c AS (SELECT u AS read, u AS l FROM bb UNION SELECT bb.u, c.l FROM c JOIN bb ON bb.v = c.read)
        SELECT read, min(l) AS cluster FROM c GROUP BY read""",
    "graph_string_edges": f"""WITH {OV}, l AS (SELECT *, {_loc(100)} AS loc, {LEN} AS n FROM ov), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY n DESC, ol_id) AS rn FROM l WHERE loc IN ('left', 'right') AND a_id <> b_id) WHERE rn = 1),
        x AS (SELECT *, a_strand = b_strand AS same, (loc = 'left') = (a_strand = b_strand) AS r FROM o), y AS (SELECT *, CASE WHEN r = same THEN 'E' ELSE 'B' END AS bf FROM x)
        SELECT a_id || ':' || CASE WHEN r THEN 'E' ELSE 'B' END AS in_node, b_id || ':' || bf AS out_node, CASE bf WHEN 'E' THEN b_len - b_end ELSE b_start END AS len, n AS score FROM y
        UNION ALL SELECT b_id || ':' || CASE bf WHEN 'E' THEN 'B' ELSE 'E' END, a_id || ':' || CASE WHEN r THEN 'B' ELSE 'E' END, CASE WHEN r THEN a_start ELSE a_len - a_end END, n FROM y""",
    "graph_degrees": f"WITH {EDGES}, m AS (SELECT * FROM edges), {_DEG} SELECT node, CAST(n_out AS BIGINT) AS n_out, CAST(n_in AS BIGINT) AS n_in FROM d",
    "graph_mirrored": f"WITH {_M} SELECT * FROM m",
    "graph_transitive": f"WITH {_M} {_both(_trans('m', 500), 'transitive')}",
    "graph_repeats": f"""WITH {_M}, {_DEG}, c AS (SELECT n.node AS n, e.in_node AS p, f.out_node AS w FROM d n JOIN m e ON e.out_node = n.node JOIN m f ON f.in_node = e.in_node JOIN d x ON x.node = f.out_node WHERE n.n_out = 1 AND n.n_in = 1 AND f.out_node <> n.node AND x.n_in > 1),
        r AS (SELECT p AS in_node, w AS out_node FROM c WHERE NOT EXISTS (SELECT 1 FROM m a JOIN m b ON a.out_node = b.out_node WHERE a.in_node = c.n AND b.in_node = c.w)) {_both('SELECT * FROM r', 'repeat')}""",
    "graph_best": f"WITH {_M} {_both(_best('m', 'score DESC NULLS LAST, len DESC NULLS LAST'), 'best')}",
    "graph_loops": f"WITH {_M} SELECT x.in_node, x.out_node FROM m x JOIN m y ON x.in_node = y.out_node AND x.out_node = y.in_node WHERE x.in_node < x.out_node",
    "graph_duplicates": "WITH d AS (SELECT DISTINCT edge_id, in_node, out_node, score FROM graph_edges WHERE in_node IS NOT NULL AND out_node IS NOT NULL) SELECT edge_id, score, CAST(row_number() OVER (PARTITION BY in_node, out_node ORDER BY score DESC NULLS LAST, edge_id) AS INTEGER) AS rank FROM d",
    "graph_unreliable": f"WITH {_M} {_both(_UNREL.format('m', 0.6), 'unreliable')}",
    "graph_quality": f"""WITH q0 AS (SELECT in_node, out_node, max(identity_pct) AS q FROM graph_edges WHERE in_node IS NOT NULL AND out_node IS NOT NULL AND in_node <> out_node AND identity_pct IS NOT NULL GROUP BY in_node, out_node),
        m AS (SELECT in_node, out_node, max(q) AS q FROM (SELECT * FROM q0 UNION ALL SELECT {_rev('out_node')}, {_rev('in_node')}, q FROM q0) GROUP BY in_node, out_node), mn AS (SELECT avg(q) AS mean FROM m), md AS (SELECT mean, avg(abs(q - mean)) AS dev FROM m, mn GROUP BY mean), v AS (SELECT CAST(round(q * 10000) AS BIGINT) AS z FROM m), c AS (SELECT count(*) AS n FROM v),
        me AS (SELECT z AS med, n FROM (SELECT z, row_number() OVER (ORDER BY z) AS rn FROM v), c WHERE rn = n // 2 + 1), ad AS (SELECT y FROM (SELECT abs(z - med) AS y, row_number() OVER (ORDER BY abs(z - med)) AS rn, n FROM v, me) WHERE rn = n // 2 + 1),
        t AS (SELECT (mean - 6 * 1.253::DOUBLE * dev + 2 * (med / 10000 - 6 * 1.4826::DOUBLE * (y / 10000))) / 3 AS th FROM md, me, ad),
        x AS (SELECT *, max(q) OVER (PARTITION BY in_node) AS top FROM m, t) {_both('SELECT in_node, out_node FROM x WHERE q < th AND (top >= th OR q < top)', 'quality')}""",
    "graph_unitigs": f"WITH RECURSIVE {_M}, {_CLEAN}, {_LINE} SELECT in_node, out_node, unitig, place FROM u",
    "graph_condensed": f"WITH RECURSIVE {_M}, {_CLEAN}, {_LINE} SELECT unitig, arg_min(in_node, place) AS in_node, arg_max(out_node, place) AS out_node, count(*) AS n, CAST(sum(len) AS BIGINT) AS len, min(score) AS score FROM u GROUP BY unitig",
    "graph_near": f"""WITH {EDGES}, s AS (SELECT DISTINCT in_node AS a, out_node AS b FROM edges UNION SELECT out_node, in_node FROM edges), n0 AS (SELECT ctg_name || ':B' AS node FROM contigs UNION SELECT ctg_name || ':E' FROM contigs),
        n1 AS (SELECT DISTINCT b AS node FROM n0 JOIN s ON a = node), n2 AS (SELECT DISTINCT b AS node FROM n1 JOIN s ON a = node), n3 AS (SELECT DISTINCT b AS node FROM n2 JOIN s ON a = node)
        SELECT node, min(d) AS depth FROM (SELECT node, 0 AS d FROM n0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2 UNION ALL SELECT node, 3 FROM n3) GROUP BY node""",
}
