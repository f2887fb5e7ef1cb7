"""Random overlaps for the tests."""

import random

OVERLAP = "ol_id long, a_id long, a_strand int, a_start int, a_end int, a_len int, b_id long, b_strand int, b_start int, b_end int, b_len int, identity double"


def random_overlaps(spark, n, seed):
    rnd = random.Random(seed)
    length = {i: rnd.randrange(200, 900) for i in range(25)}
    out = []
    for i in range(n):
        a, b = rnd.sample(sorted(length), 2)
        x, y = sorted(rnd.sample(range(length[a] + 1), 2)), sorted(rnd.sample(range(length[b] + 1), 2))
        out.append((i, a, 0, *x, length[a], b, rnd.randrange(2), *y, length[b], rnd.choice([90.0, 95.0, None])))
    return spark.createDataFrame(out, OVERLAP)
