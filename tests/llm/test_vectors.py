"""Searches over vectors against plain versions."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm.negatives import hard_negatives, integer_products
from wattframe.llm.neighbours import nearest, one_bit, rotation
from wattframe.llm.queries import ORACLES, QUERIES

SCHEMA = (
    "vec_id long, embedding array<float>, label int, row string, id string, vec string, dim string, query string, "
    "score string, rank string, anchor string, slot string, row_block string, query_block string, n string, norm string"
)


def vectors(n=400, dim=12, seed=3):
    """Vectors in a few clusters, some whole, equal, null, zero, short or not finite; ids repeat and may be null."""
    random = np.random.default_rng(seed)
    middles = random.standard_normal((6, dim)) + 0.5
    found = []
    for i in range(n):
        v = (middles[random.integers(6)] + 0.7 * random.standard_normal(dim)) * random.uniform(0.2, 3)
        found.append([i * 5 - 50, v.astype(np.float32).tolist(), int(random.integers(10))])
    found[7][1] = None
    found[8][1] = []
    found[9][1] = [0.0] * dim
    found[10][1][3] = None
    found[12][1][0] = float("nan")
    found[13][1][0] = float("inf")
    found[14][2] = None
    found[15][0] = None
    for i in range(20, 32):  # equal vectors: ties
        found[i][1] = found[20][1]
    found += [list(found[20]), list(found[40]), list(found[40])]  # repeated rows
    found += [[10_000 + 20 * i, random.standard_normal(5).tolist(), i % 3] for i in range(8)]  # another length
    found += [[20_000, [1.0], 1], [20_100, [0.0, 0.0], 1], [None, found[20][1], 4]]
    return [(*f, *"abcdefghijklm") for f in found]


def frame(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def valid(rows, zero):
    good = [r for r in rows if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    return [r for r in good if zero or any(r.embedding)]


def brute_nearest(rows, k, step):
    rows = valid(rows, False)
    found = Counter()
    for q in rows:
        if q.vec_id is None or q.vec_id % step:
            continue
        own = np.array(q.embedding)
        scored = [(float(own @ np.array(r.embedding)), r.vec_id) for r in rows if r is not q and len(r.embedding) == len(own)]
        scored.sort(key=lambda s: (-round(s[0], 9), s[1] is None, s[1] or 0))
        for rank, (score, other) in enumerate(scored[:k], 1):
            found[(q.vec_id, rank, other, round(score, 9))] += 1
    return found


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_nearest_equals_brute_force(spark, block_bytes):
    df = frame(spark)
    got = nearest(df, F.col("vec_id") % 20 == 0, k=7, block_bytes=block_bytes).collect()
    want = brute_nearest(df.collect(), 7, 20)
    found = Counter((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in got)
    assert found.total() == want.total() > 100
    assert (found & want).total() >= 0.99 * want.total()


def test_the_bound_decides_recall_and_blocks_do_not(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.standard_normal(32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(df.collect(), 20, 100)
    shares = []
    for bound in (0.0, 3.0):
        got = nearest(df, F.col("vec_id") % 100 == 0, bound=bound, block_bytes=200_000).collect()
        shares.append(len({(r.query_id, r.id) for r in got} & {(q, o) for q, _, o, _ in want}) / want.total())
    assert shares[0] < shares[1] and shares[1] >= 0.98


def test_estimates_are_without_bias_and_within_their_error():
    random = np.random.default_rng(2)
    rest, query = random.standard_normal((4000, 64)), random.standard_normal(64)
    turn = rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, scale, error = one_bit(rest, turn)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    off = (scale * (signs @ (query @ turn)) - rest @ query) / (error * np.linalg.norm(query))
    assert abs(off.mean()) < 0.05 and 0.9 < off.std() < 1.1
    assert (np.abs(off) < 3).mean() > 0.99


def test_one_bit_of_nothing_is_exact():
    code, scale, error = one_bit(np.zeros((2, 8)), rotation(8, 1))
    assert (scale == 0).all() and (error == 0).all() and len(code) == 2


def test_hard_negatives_equal_sql(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = Counter(connection.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op11_hard_negatives']})").fetchall())
    got = QUERIES["op11_hard_negatives"](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == want
    assert want.total() > 100
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    small = hard_negatives(df, F.col("vec_id") % 100 == 0, shifted, block_bytes=3000).select(*names).collect()
    assert Counter(map(tuple, small)) == want


def test_windows_overlap_and_end_at_their_limits(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [4.0, 0.0], 1), (2, [3.5, 0.0], 1), (3, [3.2, 0.0], 2), (4, [3.5, 0.0], 2), (5, [4.1, 0.0], 2)]
    rows += [(6, [2.8, 0.0], 2), (7, [2.79, 0.0], 3), (8, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") == 0, F.col("label"), positives=3, negatives=2, scale=100).collect()
    assert sorted((r.positive_id, r["rank"], r.negative_id, r.negative_score) for r in got) == [
        (1, 1, 4, 35000), (1, 2, 3, 32000), (2, 1, 4, 35000), (2, 2, 3, 32000)
    ]


def test_products_are_exact_or_an_error():
    big = np.array([[2**40, 3], [5, 2**41]], np.int64)
    assert integer_products(big, np.array([[2**15, 1], [1, 7]], np.int64)).tolist() == [[2**55 + 3, 2**40 + 21], [5 * 2**15 + 2**41, 5 + 7 * 2**41]]
    far = np.array([[2**62, 1]], np.int64)
    assert integer_products(far, np.array([[1, -(2**62)]], np.int64)).tolist() == [[0]]
    with pytest.raises(OverflowError):
        integer_products(far, far)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(100, [1.0], 1)], [(None, None, None)]])
def test_little_or_nothing(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert nearest(df, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect() == []
