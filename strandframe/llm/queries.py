"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import cohesion, components, containers, mixture, radix, residue, spans, tokens, top_n, windows
from strandframe.session import cut, skew_join, table

LIMIT, OVERLAP = 60_000, 2_000
TEXT_LIMIT, TEXT_OVERLAP = 8_000, 200
PERCENTS = [50, 90, 99]
SPAN = 100
CAPACITY = 2_048
#: Tilt of the curriculum: reference texts come later, logs and crawled pages earlier.
TILTS = {"wiki": 0.5, "methods_draft": 0.5, "run_log": -0.5, "web_crawl": -0.25}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the window jobs longer than LIMIT bases."""
    jobs = table(spark, sf_dir, "window_jobs").where("job_id is not null").groupBy("job_id").agg(F.max(F.struct("seq_id", "win_start", "win_end")).alias("j")).select("job_id", "j.*")
    lens = table(spark, sf_dir, "seq_index").where("seq_len is not null").groupBy("seq_id").agg(F.max("seq_len").alias("seq_len"))
    known = skew_join(jobs, lens, ["seq_id"])
    ready = known.select(F.col("job_id").alias("job"), F.col("seq_id").alias("seq"), F.col("win_start").alias("start"), F.least("win_end", "seq_len").alias("end"))
    flat = F.lit(0).alias("level"), F.lit(0.0).alias("depth")
    joints = table(spark, sf_dir, "contig_tiles").select(F.col("seq_id").alias("seq"), F.col("tile_end").alias("pos"), *flat)
    out = windows.split_items(ready, joints, LIMIT, OVERLAP)
    return out.withColumnRenamed("job", "job_id")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents longer than TEXT_LIMIT letters, cut in the deepest valleys of lexical cohesion."""
    return cohesion.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", TEXT_LIMIT, TEXT_OVERLAP)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best out edges of every node over the latest row of every edge."""
    edges = table(spark, sf_dir, "graph_edges").select("edge_id", "loaded_at", "in_node", "score", "identity_pct", "snp_same", "snp_diff")
    rows = cut(top_n.latest(edges, "edge_id", "loaded_at").where("in_node is not null and score is not null"))
    snp = F.coalesce(F.col("snp_same"), F.lit(0)) - 2 * F.coalesce(F.col("snp_diff"), F.lit(0))
    return top_n.top_n(rows, ["in_node"], [snp, F.col("score"), F.col("identity_pct")], "edge_id", 3).select("in_node", "edge_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group id for all reads linked directly or through others."""
    edges = components.links(table(spark, sf_dir, "read_overlaps"), "qid", "tid")
    return components.groups(edges).select(F.col("x").alias("read_id"), "group_id")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four metrics of read_stats in long form, repaired: an identity of at most 1 was loaded as a fraction and is
    taken times 100, an overhang of -1 means none, and one below -1 lost its 17th bit in 16-bit storage (plus 65,536).
    Nulls and NaN are no values; repeated rows count as stored."""

    def overhang(c: str) -> Column:
        v = F.col(c).cast("int")
        return F.when(v == -1, None).when(v < -1, v + 65_536).otherwise(v)

    identity = F.col("identity_pct").cast("double")
    metrics = {"identity_pct": F.when(identity <= 1, identity * 100).otherwise(identity), "mate_len": F.col("mate_len"), "overhang_l": overhang("overhang_l"), "overhang_r": overhang("overhang_r")}
    return radix.long_form(table(spark, sf_dir, "read_stats"), ["lib_name", "run_day"], metrics)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per library and day, and over all days from the combined day results."""
    return radix.percentiles(_stats(spark, sf_dir), ["lib_name", "run_day"], ["lib_name"], PERCENTS)


def p5_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day results that can be combined: counts per leading digit."""
    return radix.summary(_stats(spark, sf_dir), ["lib_name", "run_day"])


def p5_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from the day results alone, with their error bound."""
    return radix.percentiles(_stats(spark, sf_dir), ["lib_name", "run_day"], ["lib_name"], PERCENTS, digits=radix.DIGITS[:1])


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "seq_reads"), "read_id", "seq", SPAN)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of bases shared with another read in stretches of SPAN or more."""
    return _shared(spark, sf_dir).select(F.col("id").alias("read_id"), F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def p6_shared_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared bases and runs of every read with a sequence."""
    reads = table(spark, sf_dir, "seq_reads").where("read_id is not null and seq is not null").groupBy("read_id").agg(F.max(F.length("seq")).alias("bases"))
    got = _shared(spark, sf_dir).groupBy("id").agg(F.sum(F.col("e") - F.col("s")).alias("shared_bases"), F.count("s").alias("runs"))
    return reads.join(got, F.col("id") == F.col("read_id"), "left").select("read_id", "bases", F.coalesce("shared_bases", F.lit(0)).alias("shared_bases"), F.coalesce("runs", F.lit(0)).alias("runs"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, in pieces of at most CAPACITY tokens."""
    return containers.fill(_sizes(spark, sf_dir), "doc_id", "tokens", CAPACITY)


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, those without a place for each piece, those cut although they fit, and overfull containers (0 each)."""
    placed = cut(p7_containers(spark, sf_dir))
    n = F.when(F.col("size") > 0, 1).otherwise(0)
    per = placed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.sum(n).alias("need"), F.count("container").alias("have"))
    docs = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("need != have")).alias("unplaced"), F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("size") / CAPACITY))).alias("cut_needlessly"))
    over = containers.fills(placed).agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"))
    return docs.withColumn("overfull", over.scalar())


def p7_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and used tokens of every container."""
    return containers.fills(p7_containers(spark, sf_dir))


def _drawn(spark: SparkSession, sf_dir: str, total: float | None = None) -> DataFrame:
    return mixture.draw(_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"), total=total, wanted=TILTS)


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is used within the integrated schedule of its source."""
    return _drawn(spark, sf_dir).select("doc_id", "source", "tokens", "uses")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source: ``met``, as large as all shares allow, and ``all``, as large as the tokens of
    all sources with a target, where the scarce ones stay below their share."""
    targets = table(spark, sf_dir, "source_targets")
    met = cut(_drawn(spark, sf_dir))
    total = met.where("available is not null").agg(F.sum("tokens")).first()[0]
    every = mixture.draw(met.select("doc_id", "source", "tokens"), targets, total=float(total or 0), wanted=TILTS)
    return mixture.shares(met, targets).withColumn("mixture", F.lit("met")).unionByName(mixture.shares(cut(every), targets).withColumn("mixture", F.lit("all")))


def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training position of every use under the tilted curriculum."""
    return mixture.positions(_drawn(spark, sf_dir)).select("doc_id", "source", "use_no", "position")


def p8_shares_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled and reached share of every source in each tenth of the training."""
    return mixture.shares_by_time(cut(_drawn(spark, sf_dir)))


def p8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source, and those used more often than allowed or without a target (0)."""
    drawn = _drawn(spark, sf_dir)
    most = table(spark, sf_dir, "source_targets").groupBy("source").agg(F.max("max_repeats").alias("most"))  # one row per source
    rows = drawn.select("source", "uses").join(most, "source", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("uses") > F.coalesce("most", F.lit(0))).alias("too_often"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, or an error page or script notice in place of content."""
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified messages with the number of documents that hold them."""
    return residue.residue_messages(table(spark, sf_dir, "documents"), "doc_id", "text", "source")[1].select("hash", "docs", "sources", "message", "kind")


QUERIES = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_percentiles": p5_percentiles,
    "p5_day_summaries": p5_day_summaries,
    "p5_bounded": p5_bounded,
    "p6_found": p6_found,
    "p6_shared_bases": p6_shared_bases,
    "p7_containers": p7_containers,
    "p7_fills": p7_fills,
    "p7_valid": p7_valid,
    "p8_uses": p8_uses,
    "p8_shares": p8_shares,
    "p8_order": p8_order,
    "p8_shares_by_time": p8_shares_by_time,
    "p8_valid": p8_valid,
    "p9_found": p9_found,
    "p9_messages": p9_messages,
}

_VALUES = """m AS (
            SELECT lib_name, run_day, 'identity_pct' AS metric, CASE WHEN CAST(identity_pct AS DOUBLE) <= 1 THEN CAST(identity_pct AS DOUBLE) * 100 ELSE CAST(identity_pct AS DOUBLE) END AS x FROM read_stats WHERE identity_pct IS NOT NULL AND NOT isnan(identity_pct)
            UNION ALL SELECT lib_name, run_day, 'mate_len', mate_len FROM read_stats WHERE mate_len IS NOT NULL
            UNION ALL SELECT lib_name, run_day, 'overhang_l', CASE WHEN overhang_l < -1 THEN CAST(overhang_l AS INTEGER) + 65536 ELSE overhang_l END FROM read_stats WHERE overhang_l <> -1
            UNION ALL SELECT lib_name, run_day, 'overhang_r', CASE WHEN overhang_r < -1 THEN CAST(overhang_r AS INTEGER) + 65536 ELSE overhang_r END FROM read_stats WHERE overhang_r <> -1)"""
#: The leading 20 bits of values of at least 0: the exponent and eight bits of the fraction.
_PREFIX = """, e0 AS (SELECT *, floor(log2(nullif(x, 0))) AS e FROM m), e1 AS (SELECT * REPLACE (CASE WHEN x / pow(2.0::DOUBLE, e) >= 2 THEN e + 1 WHEN x / pow(2.0::DOUBLE, e) < 1 THEN e - 1 ELSE e END AS e) FROM e0),
        c AS (SELECT lib_name, run_day, metric, x, CASE WHEN x = 0 THEN 0 ELSE CAST((e + 1023) * 256 + floor((x / pow(2.0::DOUBLE, e) - 1) * 256) AS BIGINT) END AS prefix FROM e1)"""
_LOW = "(CASE WHEN {0} < 256 THEN {0} * pow(2.0::DOUBLE, -1030) ELSE (1 + ({0} % 256) / 256.0::DOUBLE) * pow(2.0::DOUBLE, {0} // 256 - 1023) END)"
_SPANS = """WITH r AS (SELECT DISTINCT read_id, seq FROM seq_reads WHERE read_id IS NOT NULL AND length(seq) >= 100), w AS (SELECT read_id, i - 1 AS p, substr(seq, CAST(i AS BIGINT), 100) AS k FROM r, unnest(range(1, length(seq) - 98)) AS t(i)),
    s AS (SELECT k FROM w GROUP BY k HAVING min(read_id) < max(read_id)), c AS (SELECT DISTINCT read_id, p FROM w SEMI JOIN s USING (k)), n AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY read_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS f FROM c),
    g AS (SELECT *, sum(f) OVER (PARTITION BY read_id ORDER BY p) AS run FROM n), spans AS (SELECT read_id, CAST(min(p) AS BIGINT) AS span_start, CAST(max(p) + 100 AS BIGINT) AS span_end FROM g GROUP BY read_id, run)"""

SQL = {
    "p7_valid": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS overfull FROM documents",
    "p8_valid": "SELECT source, count(*) AS documents, CAST(0 AS BIGINT) AS too_often FROM documents GROUP BY source",
    "p6_found": _SPANS + " SELECT read_id, span_start, span_end FROM spans",
    "p6_shared_bases": _SPANS + """, b AS (SELECT read_id, max(length(seq)) AS bases FROM seq_reads WHERE read_id IS NOT NULL AND seq IS NOT NULL GROUP BY read_id), x AS (SELECT read_id, CAST(sum(span_end - span_start) AS BIGINT) AS n, count(*) AS runs FROM spans GROUP BY read_id)
        SELECT read_id, CAST(bases AS INTEGER) AS bases, coalesce(n, 0) AS shared_bases, coalesce(runs, 0) AS runs FROM b LEFT JOIN x USING (read_id)""",
    "p1_found": """
        WITH RECURSIVE lens AS (SELECT seq_id, max(seq_len) AS seq_len FROM seq_index WHERE seq_len IS NOT NULL GROUP BY seq_id),
        jobs AS (SELECT DISTINCT job_id, w.seq_id, win_start, least(win_end, seq_len) AS stop FROM window_jobs w JOIN lens USING (seq_id) WHERE job_id IS NOT NULL),
        tiles AS (SELECT DISTINCT seq_id, tile_end FROM contig_tiles WHERE tile_end IS NOT NULL),
        pieces AS (
            SELECT job_id, seq_id, stop, win_start AS s, CASE WHEN stop - win_start <= 60000 THEN stop ELSE coalesce((SELECT max(tile_end) FROM tiles t WHERE t.seq_id = jobs.seq_id AND tile_end > win_start + 2000 AND tile_end <= win_start + 60000), win_start + 60000) END AS e
            FROM jobs WHERE stop - win_start > 60000
            UNION ALL
            SELECT job_id, seq_id, stop, e - 2000, CASE WHEN stop - (e - 2000) <= 60000 THEN stop ELSE coalesce((SELECT max(tile_end) FROM tiles t WHERE t.seq_id = p.seq_id AND tile_end > e AND tile_end <= e + 58000), e + 58000) END
            FROM pieces p WHERE e < stop)
        SELECT job_id, s AS piece_start, e AS piece_end FROM pieces""",
    "p3_found": """
        WITH l AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM graph_edges),
        r AS (SELECT in_node, edge_id, row_number() OVER (PARTITION BY in_node ORDER BY coalesce(snp_same, 0) - 2 * coalesce(snp_diff, 0) DESC, score DESC, identity_pct DESC NULLS LAST, edge_id) AS k
              FROM l WHERE rn = 1 AND in_node IS NOT NULL AND score IS NOT NULL)
        SELECT in_node, edge_id FROM r WHERE k <= 3""",
    "p4_found": """
        WITH RECURSIVE e AS (SELECT DISTINCT qid AS a, tid AS b FROM read_overlaps WHERE qid IS NOT NULL AND tid IS NOT NULL AND qid <> -1 AND tid <> -1 AND qid <> tid),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        c AS (SELECT a, a AS r FROM s UNION SELECT s.a, c.r FROM c JOIN s ON s.b = c.a)
        SELECT a AS read_id, min(r) AS group_id FROM c GROUP BY a""",
    "p5_percentiles": """
        WITH """ + _VALUES + """,
        g AS (SELECT lib_name, run_day, 'part' AS level, metric, x FROM m UNION ALL SELECT lib_name, NULL, 'all', metric, x FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY level, lib_name, run_day, metric ORDER BY x) AS rn, count(*) OVER (PARTITION BY level, lib_name, run_day, metric) AS n FROM g),
        p AS (SELECT unnest([50, 90, 99]) AS percent)
        SELECT lib_name, run_day, level, metric, CAST(percent AS INTEGER) AS percent, n, x AS value, CAST(0 AS DOUBLE) AS max_error FROM r JOIN p ON rn = greatest(1, (n * percent + 99) // 100)""",
    "p5_day_summaries": f"WITH {_VALUES}{_PREFIX} SELECT lib_name, run_day, metric, prefix, count(*) AS n FROM c GROUP BY lib_name, run_day, metric, prefix",
    "p5_bounded": f"""WITH {_VALUES}{_PREFIX}, g AS (SELECT lib_name, run_day, 'part' AS level, metric, prefix FROM c UNION ALL SELECT lib_name, NULL, 'all', metric, prefix FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY level, lib_name, run_day, metric ORDER BY prefix) AS rn, count(*) OVER (PARTITION BY level, lib_name, run_day, metric) AS n FROM g), p AS (SELECT unnest([50, 90, 99]) AS percent)
        SELECT lib_name, run_day, level, metric, CAST(percent AS INTEGER) AS percent, n, {_LOW.format("prefix")} AS value, {_LOW.format("(prefix + 1)")} - {_LOW.format("prefix")} AS max_error FROM r JOIN p ON rn = greatest(1, (n * percent + 99) // 100)""",
}
