"""Splitting oversized items at natural joints, with a fixed overlap.

From a piece start p the piece takes all that is left if that is at most ``limit``; else it ends at a joint b with p + overlap
< b <= p + limit: the one of the highest level, of these the deepest valley, of equal ones the farthest. Without a joint there
it ends at p + limit. The next piece starts ``overlap`` before that end. Levels and depths of texts come from ``cohesion``;
the joints of contig tiles have no vocabulary and all the same depth.

No item is gathered in one task. The step from one joint to the next does not depend on where the item began, so it is computed
once per joint; items then reach all their joints by doubling (steps of 1, 2, 4 ... joints), with joins on (sequence, joint).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import cut, drop, is_empty, n_rows, n_where, sized, skew_join


def best_joints(states: DataFrame, joints: DataFrame, width: int) -> DataFrame:
    """For distinct states (seq, b): ``best``, struct (level, depth, pos) of the best joint in (b, b + width], and ``succ``, the
    smallest joint beyond b, each null if there is none.

    Positions are cut into buckets of ``width``. A window of that width covers the rest of one bucket and the beginning of
    the next, so running maxima from both ends of every bucket hold all answers; a sort group has one bucket's rows only,
    and a second level runs over one row per bucket of a sequence."""
    none = F.lit(None).cast("struct<level:int,depth:double,pos:bigint>")
    item = F.struct(F.col("level").cast("int").alias("level"), F.col("depth").cast("double").alias("depth"), F.col("pos").cast("long").alias("pos"))
    rows = joints.select("seq", F.col("pos").alias("at"), F.lit(0).alias("kind"), item.alias("joint"))
    rows = rows.unionByName(states.select("seq", F.explode(F.array(F.struct(F.col("b").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("b") + width).alias("at"), F.lit(2).alias("kind")))).alias("_q")).select("seq", "_q.at", "_q.kind", none.alias("joint")))
    rows = rows.withColumn("bucket", F.expr(f"cast(floor(at / {width}) as bigint)"))
    part = Window.partitionBy("seq", "bucket")
    up = part.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("seq", "bucket", "at", "kind", F.max("joint").over(up).alias("u"), F.max("joint").over(down).alias("d"), F.min("joint.pos").over(down).alias("s")).where("kind > 0")
    levels = rows.where("kind = 0").groupBy("seq", "bucket").agg(F.min("at").alias("lo"))
    levels = levels.unionByName(states.select("seq", F.expr(f"cast(floor(b / {width}) as bigint)").alias("bucket"), F.lit(None).cast("long").alias("lo"))).groupBy("seq", "bucket").agg(F.min("lo").alias("lo"))
    after = F.last("lo", ignorenulls=True).over(Window.partitionBy("seq").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select("seq", "bucket", after.alias("after"))
    first = F.col("kind") == 1
    per = seen.groupBy("seq", F.when(first, F.col("at")).otherwise(F.col("at") - width).alias("b")).agg(
        F.max(F.when(first, F.col("d")).otherwise(F.col("u"))).alias("best"), F.min(F.when(first, F.col("s"))).alias("succ"), F.min(F.when(first, F.col("bucket"))).alias("bucket")
    )
    return per.join(levels, ["seq", "bucket"], "left").select("seq", "b", "best", F.coalesce("succ", "after").alias("succ"))


def steps(states: DataFrame, joints: DataFrame, limit: int, overlap: int) -> DataFrame:
    """For each state (seq, b), a piece starting at b - overlap: the next joint used as an end, ``nxt``, and the ``hard``
    cuts before it. Without any later joint ``nxt`` is null."""
    adv = limit - overlap
    near = cut(best_joints(states, joints, adv), gap=F.col("best").isNull() & F.col("succ").isNotNull())
    zero = F.lit(0).cast("long").alias("hard")
    done = near.where("best is not null or succ is null").select("seq", "b", F.col("best.pos").alias("nxt"), zero)
    if not n_where(near, "gap"):
        return sized(done, n_rows(near))
    gap = near.where("best is null and succ is not null").withColumn("hard", F.expr(f"(succ - b - 1) div {adv}")).withColumn("x", F.col("b") + adv * F.col("hard"))
    far = best_joints(gap.select("seq", F.col("x").alias("b")).distinct(), joints, adv).select("seq", F.col("b").alias("x"), F.col("best.pos").alias("nxt"))
    return cut(done.unionByName(gap.select("seq", "b", "hard", "x").join(far, ["seq", "x"]).select("seq", "b", "nxt", "hard")))


def split_items(jobs: DataFrame, joints: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces (job, piece_start, piece_end) of the jobs (job, seq, start, end) longer than ``limit``.

    ``joints`` has (seq, pos, level, depth), repeats and null positions allowed; a null level or depth ranks lowest. Jobs with a null field or not longer than ``limit`` give no
    row; equal jobs under different ids give rows each; ``job`` must be unique. Empty tables give an empty table."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    adv = limit - overlap
    jobs = cut(
        jobs.select("job", "seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        .where(f"job is not null and seq is not null and end - start > {limit}")
        .withColumn("b", F.col("start") + overlap)
        .drop("start")
    )
    known = joints.where("pos is not null").join(jobs.select("seq").distinct(), "seq", "left_semi")
    joints = known.groupBy("seq", F.col("pos").cast("long").alias("pos")).agg(F.max(F.struct("level", "depth")).alias("_v")).select("seq", "pos", "_v.level", "_v.depth")
    joints = cut(joints)
    states = joints.select("seq", F.col("pos").alias("b")).union(jobs.select("seq", "b")).distinct()
    step = steps(states, joints, limit, overlap)
    # jump: the joint 2**k uses on, and the job end above which the last piece before it is not the job's last
    jump = step.where("nxt is not null").select("seq", "b", F.col("nxt").alias("to"), (F.col("b") + adv * (F.col("hard") + 1)).alias("needs"))
    reached = jobs
    parts = [jobs]
    while True:
        more = cut(skew_join(reached, jump, ["seq", "b"]).where("end > needs").select("job", "seq", "end", F.col("to").alias("b")))
        if is_empty(more):
            break
        parts.append(more)
        reached = sized(reduce(DataFrame.unionByName, parts), sum(map(n_rows, parts)))
        far = jump.select("seq", F.col("b").alias("to"), F.col("to").alias("to2"), F.col("needs").alias("needs2"))
        last, jump = jump, cut(jump.join(far, ["seq", "to"]).select("seq", "b", F.col("to2").alias("to"), F.col("needs2").alias("needs")))
        drop(last)
    rows = skew_join(reached, step, ["seq", "b"]).withColumn("lasting", F.expr(f"greatest(0, (end - b + {adv - 1}) div {adv} - 1)"))
    rows = rows.withColumn("final", F.col("nxt").isNull() | (F.col("lasting") <= F.col("hard"))).withColumn("top", F.when(F.col("final"), F.col("lasting")).otherwise(F.col("hard")))
    piece = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))))
    hard_end = F.col("b") + adv * (F.col("i") + 1)
    end = F.when(F.col("i") < F.col("top"), hard_end).when(F.col("final"), F.col("end")).otherwise(F.col("nxt"))
    return piece.select("job", (F.col("b") - overlap + adv * F.col("i")).alias("piece_start"), end.alias("piece_end"))
