"""Table functions from SQL against the kernels and plain folds."""

import random

import duckdb
import pytest

from lexweave.functions import segmentation, table_functions
from lexweave.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def test_paths_and_tails(spark, sql):
    texts = ["한전에서 servers", None, "", "금감원장! 한전노조가", "한전에서 servers"]
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").createOrReplaceTempView("texts")
    got = sorted(map(repr, (tuple(r) for r in sql("SELECT i, p.start, p.core, p.shape, p.score FROM texts, LATERAL lexical_paths(t) p").collect())))
    want = [(i, a, c, t.shape(), round(s, 6)) for i, x in enumerate(texts) for a, _, token, _ in segmentation.token_spans(x or "") for c, t, s in segmentation.paths(token)]
    assert got == sorted(map(repr, want)) and len(got) > 10
    tails = sql("SELECT residual, score FROM lexical_tails('노조가', '전')").collect()
    assert [(r[0], r[1]) for r in tails] == [(t.residual, round(t.score, 6)) for t in segmentation.tails("노조가", "전")]
    with pytest.raises(Exception, match="type string"):
        sql("SELECT * FROM lexical_paths(1)").collect()


def test_merged_spans(spark, sql):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, None]), a := rnd.randint(0, 90), a + rnd.randint(0, 6)) for _ in range(80)] + [(1, None, 4), (2, 3, None)]
    spark.createDataFrame(rows, "key int, start bigint, end bigint").createOrReplaceTempView("spans")
    got = {tuple(r) for r in sql("SELECT * FROM merged_spans(TABLE(spans) PARTITION BY key ORDER BY start)").collect()}
    want = set()
    for key in (1, 2, None):
        held = None
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None):
            if held and a <= held[1]:
                held = (held[0], max(held[1], b), held[2] + 1)
            else:
                want |= {(key, *held)} if held else set()
                held = (a, b, 1)
        want |= {(key, *held)} if held else set()
    assert got == want
    assert sql("SELECT * FROM merged_spans(TABLE(SELECT * FROM spans WHERE false) PARTITION BY key ORDER BY start)").count() == 0
    with pytest.raises(Exception, match="columns key, start and end"):
        sql("SELECT * FROM merged_spans(TABLE(SELECT start FROM spans) PARTITION BY start)").collect()


def test_shapes_add_up_paths(spark, sql):
    texts = ["한전에서 servers 한전에서", None, "", "금감원장! 한전노조가 x", "servers AP's"]
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").createOrReplaceTempView("texts")
    want = sql("SELECT i, shape, count(*), sum(length(core)) FROM texts, LATERAL lexical_paths(t) GROUP BY i, shape").collect()
    got = [tuple(r) for r in sql("SELECT i, shape, n, chars FROM texts, LATERAL lexical_shapes(t)").collect()]
    assert sorted(got) == sorted(tuple(r) for r in want) and len(got) > 5


def test_merged_lines_without_quantity_or_number(spark, tmp_path):
    """Lines without a quantity or a number are counted, and quantities round, as in the SQL; equal spans all stand alone here, so that their order is of no matter."""
    rows = [
        (1, 3.0, 1), (1, 2.5, 7), (1, 9.5, 2), (1, 12.5, None), (1, 14.0, 1), (1, 14.6, None), (1, None, 2), (1, None, None), (1, None, 5),
        (2, None, 1), (3, 8.0, None), (3, 8.0, 4), (3, 11.5, None), (3, 20.0, None), (3, 20.0, None), (3, 21.0, 3),
        (None, 4.0, 2), (None, 7.0, 1), (None, None, 3), (4, 10.0, -8), (4, 1.0, 4), (4, 10.0, 1), (4, 1.5, 1),
    ]
    spark.createDataFrame(rows, "l_orderkey bigint, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["e10_merged_spans"]).fetchall()
    got = [tuple(r) for r in QUERIES["e10_merged_spans"](spark, str(tmp_path)).select("key", "start", "end", "spans").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[3] for r in got) == len(rows)
