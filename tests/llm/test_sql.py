"""Operators whose results SQL can express, against DuckDB: the tables of sf0.01
and a small set with equal pages and vectors, repeated lines, nulls and empty texts."""

import duckdb
import pandas as pd
import pytest

from tidemark.llm import entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = ["documents", "benchmark", "pages", "embeddings"]


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}'")
    want, got = con.execute(SQL[name]).df(), QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    same = [df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns[:1] if name != "op8_line_dedup" else ["doc_id"], kind="stable") for df in (got, want)]
    rows = [sorted(map(str, df.itertuples(index=False, name=None))) for df in (x.map(lambda v: int(v) if isinstance(v, float) and v.is_integer() else v) for x in same)]
    assert rows[0] == rows[1]
    return pd.DataFrame(got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_tables(spark, name):
    assert len(compare(spark, name, "/root/testdata/sf0.01")) > 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sql"))
    item = "one two three four five six seven eight nine ten eleven"
    line = "a line of some length that many of the documents share with others"
    texts = [None, "", "   \n\n", line, f"{line}\nits own", f"{line.upper()}!\n{line}", f"see {item} there", "nine ten", "nine ten\n\tnine  ten", f"x{item}", *[f"{line} {i}" for i in range(5)], "https://example.org/one/page", "https://other.net/two"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Nine, TEN"), (10, item.upper())], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>ü</p>", "<p>a</p>", "<p>A</p>"]
    spark.createDataFrame([(i, f"https://e.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    near = [[1.0, 0.0, 0.0], [0.95, 0.1, 0.0], [0.8, 0.35, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 2.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [1.0, 0.0], []]
    vectors = [(i, near[i % len(near)], [None, 0, 1][(i // len(near)) % 3]) for i in range(210)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_small(spark, name, small):
    got = compare(spark, name, small)
    got = got.set_index(got.columns[0])
    if "warc" in name:
        assert got["refers_to"].dropna().to_dict() == {0: 1, 2: 5, 3: 5}
    if "op1_" in name:
        assert got["n_hit"].to_dict() | {6: 11, 7: 2, 8: 4} == got["n_hit"].to_dict()
    if "line" in name:
        assert got["n_kept"][15] == got["n_kept"][16] == 1
