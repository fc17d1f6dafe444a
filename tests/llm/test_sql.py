"""The queries whose results SQL can express against that SQL, on the test tables and on tables of edge cases."""

from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels")


def compare(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, str(folder))
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    rng = np.random.default_rng(11)
    words = ["the", "tide", "Mark", "# $x", "naïve", "“x”", "ebb", "flow\n", "a b\na b\n", "moon"]
    texts = [None, "", " \n\t", "one", "A b c d", "a B c d", "É b", "é b", "x " * 500]
    for _ in range(40):
        base = [words[k] for k in rng.integers(0, 10, rng.integers(5, 120))] + [f"w{k}" for k in rng.integers(0, 500, 20)]
        for _ in range(rng.integers(1, 4)):
            some = list(base)
            some[rng.integers(len(some))] = "other"
            texts.append(" ".join(some))
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{min(i % 7, 2)}" if i % 11 else None, None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 1 if i % 3 == 0 else None) for i in range(0, len(texts), 2)] + [(2, 1, 0), (None, 1, 1), (10_000, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    near = np.repeat(rng.normal(size=(20, 16)), 6, 0) + rng.normal(size=(120, 16)) * 0.18
    vectors = [(i, int(i % 2), [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]
    vectors += [(200, 0, vectors[0][2]), (201, None, vectors[0][2]), (202, 1, None), (203, 1, [0.0] * 16), (204, 1, [float("nan")] * 16), (205, 1, [None] + [1.0] * 15), (206, 1, [])]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(1, "u", "a"), (2, "u2", "a"), (3, None, None), (4, "u", ""), (5, "é", "é" * 5000), (6, "v", "é" * 5000), (7, "w", "b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_edge_tables(spark, edges, name):
    compare(spark, edges, name)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_tables(spark, name):
    compare(spark, DATA, name)
