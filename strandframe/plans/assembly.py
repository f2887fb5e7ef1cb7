"""Assembly end to end: filter, group, drop contained reads, build and reduce the graph, spell contigs.

Nothing is deleted on the way: reductions carry reasons, and each stage is a table that can be looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.overlap import Filter, extended
from strandframe.operators import condensed, coverage, graph, grouping
from strandframe.session import cut


@dataclass(frozen=True)
class Options:
    """Rules of the stages. ``overlap`` is in the filter language, ``max_overhang`` the bases by which ends are snapped,
    ``strategy`` the reductions of the string graph and ``paths`` those of the condensed graph."""

    overlap: str = ""
    max_overhang: int = 100
    strategy: str = graph.STRATEGY
    paths: str = condensed.STRATEGY

    @classmethod
    def parse(cls, text: str) -> Options:
        """From lines ``key = value``; blank lines and # comments are skipped, unknown keys are an error."""
        kinds = {f.name: int if f.type == "int" else str for f in fields(cls)}
        got = {}
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, eq, value = line.partition("=")
            key = key.strip()
            if not eq or key not in kinds:
                raise ValueError(f"not an option: {line!r}")
            got[key] = kinds[key](value.strip())
        return cls(**got)


def assemble(overlaps: DataFrame, reads: DataFrame, options: Options | None = None, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by stage: kept (overlaps), contained (read, container), edges, reduced (edges and reasons), paths, tiles and
    contigs (ctg, seq). ``overlaps`` has the columns of the filter, ``reads`` (read_id, seq); ``links`` (in_node, out_node, same,
    diff) are alleles for the phase step."""
    o = options or Options()
    good = overlaps.where(Filter.parse(o.overlap).valid())
    one = grouping.duplicates(good).where("rank = 1").drop("rank", "n")
    snapped = one.withColumn("_e", extended(o.max_overhang)).where("_e is not null")
    ends = ("a_start", "a_end", "b_start", "b_end")
    kept = cut(snapped.withColumns({n: F.col(f"_e.{n}") for n in ends}).drop("_e"))
    contained = cut(grouping.contained_reads(kept))
    gone = contained.select(F.col("read").alias("a_id")).distinct()
    alive = kept.join(gone, "a_id", "left_anti").join(gone.withColumnRenamed("a_id", "b_id"), "b_id", "left_anti")
    edges = cut(graph.string_edges(alive))
    # contained reads may lead on from dead ends
    spare = cut(graph.string_edges(kept))
    left, reduced = graph.simplify(edges, o.strategy, spare=spare, links=links, cover=coverage.covers(kept))
    first = cut(graph.unitigs(left))
    whole = cut(graph.condensed(left, first))
    _, off = condensed.simplify(whole.select("in_node", "out_node", "len", "score"), o.paths)
    # an edge of the condensed graph stands for all edges of its unitig
    fallen = whole.join(off, ["in_node", "out_node"]).select("unitig", "reason")
    by_path = cut(first.join(fallen, "unitig").select("in_node", "out_node", "reason"))
    left = cut(graph.remaining(left, by_path))
    paths = cut(graph.unitigs(left))
    tiles = cut(path_tiles(left, paths, reads))
    seqs = reads.select(F.col("read_id").cast("string").alias("read"), "seq")
    return {"kept": kept, "contained": contained, "edges": edges, "reduced": reduced.unionByName(by_path), "paths": paths, "tiles": tiles, "contigs": graph.contig_sequences(tiles, seqs)}


def path_tiles(edges: DataFrame, paths: DataFrame, reads: DataFrame) -> DataFrame:
    """(ctg, tile_no, read, strand, start, end): the whole first read of a path, then what each edge adds.

    Of a path and its mirror the one with the smaller id stays; a node's strand is 0 where the walk leaves its E end."""

    def read(c: str):
        return F.expr(f"substring({c}, 1, length({c}) - 2)")

    def strand(c: str):
        return F.when(F.endswith(c, F.lit("E")), 0).otherwise(1)

    length = reads.select(F.col("read_id").cast("string").alias("read"), F.length("seq").alias("read_len"))
    rows = paths.join(edges.select("in_node", "out_node", "len"), ["in_node", "out_node"])
    ends = rows.groupBy("unitig").agg(F.min_by("in_node", "place").alias("first"), F.max_by("out_node", "place").alias("last"))
    keep = ends.where((F.col("first") < graph.rev(F.col("last"))) | ((F.col("first") == graph.rev(F.col("last"))) & (F.col("unitig") != "")))
    rows = rows.join(keep.select("unitig"), "unitig", "left_semi")
    added = rows.select(F.col("unitig").alias("ctg"), (F.col("place") + 1).alias("tile_no"), read("out_node").alias("read"), strand("out_node").alias("strand"), "len").join(length, "read")
    # what an edge adds is the far end of its read: the tail on the forward strand, the head on the other
    tail = F.col("strand") == 0
    added = added.select("ctg", "tile_no", "read", "strand", F.when(tail, F.col("read_len") - F.col("len")).otherwise(0).alias("start"), F.when(tail, F.col("read_len")).otherwise(F.col("len")).alias("end"))
    first = keep.select(F.col("unitig").alias("ctg"), F.lit(0).alias("tile_no"), read("first").alias("read"), strand("first").alias("strand")).join(length, "read")
    return first.select("ctg", "tile_no", "read", "strand", F.lit(0).alias("start"), F.col("read_len").alias("end")).unionByName(added)
