"""The top-1 search against brute force, over blocks and across labels."""

import random

import duckdb

from tidemark.operators import patterns
from tidemark.plans import oracle


def test_nearest(spark):
    rng = random.Random(6)
    vectors = [(i, rng.choice([0, 1, 2, None]), [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    vectors += [(60, 9, vectors[3][2]), (61, 8, vectors[3][2]), (80, 7, [0.0] * 5), (100, 7, None)]
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    sure = {i: [float(x) for x in v] for i, _, v in df.collect() if v and any(v)}

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 4)

    want = {q: max((cosine(v, e), -i) for i, e in sure.items() if i != q) for q, v in sure.items() if q % 20 == 0}
    assert want[60] == (1.0, -3)
    for block in (7, 1024):
        got = {r["vec_id"]: (r["similarity"], -r["match_id"]) for r in patterns.nearest(df, block=block).collect()}
        assert got == want
    assert patterns.nearest(df.limit(0)).count() == 0


def test_shape_names():
    up, down = [i / 10 - 1.5 for i in range(30)], [1.5 - i / 10 for i in range(30)]
    valley = [abs(i - 14.5) / 5 - 1.5 for i in range(30)]
    assert [patterns.shape_name(x) for x in (up, down, valley, [-v for v in valley])] == ["rising, straight", "falling, straight", "level, bottom inside", "level, top inside"]


def test_names_follow_direction(spark):
    rows = spark.createDataFrame([(0, "up"), (0, "down"), (1, "up")], "cluster int, direction string")
    got = {(r["cluster"], r["direction"]): r["pattern"] for r in patterns.named(rows, [[0.0] * 9, [float(i) for i in range(9)]]).collect()}
    assert got == {(0, "up"): "level, straight before a rise", (0, "down"): "level, straight before a fall", (1, "up"): "rising, straight before a rise"}


def test_top_in_label_blocks(spark, tmp_path):
    """The top-1 of each label against its SQL: one label of most rows, copies, null and
    zero vectors, null components, short vectors, labels of one row and of none."""
    rng = random.Random(7)
    vectors = [(i, 0 if i % 5 else i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    vectors += [(200 + i, 0, vectors[20 * i][2]) for i in range(8)]
    vectors += [(240, 5, [1.0, 0.0, 2.0, 1.0]), (241, 5, [1.0, None, 2.0, 1.0]), (242, 5, [1.0, 3.0]), (260, 5, [0.5, 3.0])]
    vectors += [(300, 6, [1.0, 2.0]), (301, 6, [0.0, 0.0]), (302, 6, [2.0, 4.0]), (320, 6, [0.0, 0.0])]
    vectors += [(340, 7, None), (341, 7, [1.0]), (342, 7, [2.0]), (360, 8, [1.0]), (380, None, [1.0]), (381, None, [1.0]), (400, 9, []), (401, 9, [3.0]), (402, 9, None)]
    vectors += [(420, 10, [1.0]), (421, 10, None), (422, 10, [-1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = sorted(map(str, con.execute(oracle.oracle_sql()["embedding_top1"]).fetchall()))
    for block in (3, 50, 2048):
        assert sorted(str(tuple(r)) for r in patterns.top_cosine(df, block=block).collect()) == want
    assert patterns.top_cosine(df.where("false")).count() == 0
