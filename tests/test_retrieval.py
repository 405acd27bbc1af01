import numpy as np
import pytest

from gristmill.functions.text import plain_number, sort_date, tokens
from gristmill.operators import retrieval
from gristmill.functions.stem import stem
from gristmill.sources.sql_surface import RefusedStatement, check_read_only, query, tables_in
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = [(0, "the bank raised capital"), (1, "Chicago manufacturing slowed, manufacturing jobs fell"), (2, "stress test of capital 3.5"), (3, ""), (4, None)]


def test_bm25_ranks_and_handles_empty_texts(spark):
    corpus = spark.createDataFrame(TEXTS, "id long, text string")
    asked = spark.createDataFrame([(1, "Chicago manufacturing"), (2, "stress test capital"), (3, None), (4, "unknown")], "query_id long, text string")
    rows = retrieval.top(retrieval.bm25(corpus, asked), 1).collect()
    assert {r.query_id: r.id for r in rows} == {1: 1, 2: 2}


def test_bm25_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert retrieval.bm25(empty, empty.withColumnRenamed("id", "query_id")).count() == 0


def test_dense_is_exact_with_ties_to_the_smaller_id(spark):
    vectors = np.random.default_rng(0).normal(size=(60, 8)).round(2)
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, vector array<double>")
    got = retrieval.top(retrieval.dense(df, df.where("id < 4").withColumnRenamed("id", "query_id"), 5), 5).collect()
    for q in range(4):
        scores = (vectors @ vectors[q]).round(6)
        want = sorted(range(60), key=lambda i: (-scores[i], i))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("Rate 3.5 of CPI", "2024-03", "$1,200.5"), (None, "2024", "n.a.")], "a string, b string, c string")
    rows = df.select(tokens(F.col("a")), sort_date(F.col("b")), plain_number(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(["rate", "3.5", "of", "cpi"], "2024-03-31", 1200.5), ([], "2024-12-31", None)]


REFUSED = [
    "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "INSERT INTO t VALUES (1)", "CREATE TABLE t AS SELECT 1", "", "SELECT * FROM `parquet`.`/x`",
    "SELECT * FROM parquet . /* x */ `/x`", "WITH x AS (SELECT 1) INSERT INTO a SELECT * FROM x", "FROM region INSERT INTO a SELECT * INSERT INTO b SELECT *", "SET a=b", "ADD JAR x",
    "SELECT reflect('java.lang.Math', 'abs', 1)", "SELECT * FROM (SELECT * FROM secret)", "SELECT (SELECT max(a) FROM hidden) FROM region",
    "SELECT * FROM region WHERE EXISTS (SELECT 1 FROM csv.`/x`)", "WITH known AS (SELECT * FROM nope) SELECT * FROM known", "SELECT * FROM default.region",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_guard_refuses(spark, sql):
    with pytest.raises(RefusedStatement):
        check_read_only(spark, sql)


def test_guard_lets_queries_through(spark):
    check_read_only(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a")
    reads = {
        "-- rates\nSELECT * FROM region": ["region"], "SELECT 'parquet.`x`' FROM region": ["region"], "DESCRIBE region": ["region"], "SHOW TABLES": [],
        "SELECT (SELECT max(r_name) FROM region) FROM nation": ["nation", "region"], "SELECT explode(array(1)) FROM range(3)": [],
        "WITH a AS (SELECT * FROM orders) SELECT * FROM a JOIN customer ON o_custkey = c_custkey": ["customer", "orders"],
    }
    for sql, tables in reads.items():
        assert tables_in(spark, sql) == tables


def test_query_limits_rows_and_time(spark):
    found = query(spark, SF, "SELECT n_name FROM nation ORDER BY n_name", 3)
    assert (len(found.rows), found.truncated, found.tables, found.error) == (3, True, ["nation"], None)
    assert query(spark, SF, "SELECT * FROM nope").error
    slow = query(spark, SF, "SELECT count(*) FROM lineitem a CROSS JOIN lineitem b CROSS JOIN lineitem c WHERE a.l_tax + b.l_tax > c.l_tax", timeout=2)
    assert "too long" in slow.error


def test_stems_and_stop_words(spark):
    df = spark.createDataFrame([(0, "Banks' capital ratios"), (1, "the of"), (2, None)], "id long, text string")
    got = {(r.id, r.term) for r in retrieval.postings(df, analysed=True).collect()}
    assert got == {(0, "bank"), (0, "capit"), (0, "ratio"), (0, ""), (1, ""), (2, "")}
    words = {"generously": "generous", "hopping": "hop", "hoping": "hope", "agreed": "agre", "cries": "cri", "ties": "tie", "communities": "communiti", "relational": "relat", "vietnamization": "vietnam", "rolling": "roll", "dying": "die", "3.5": "3.5"}
    assert {w: stem(w) for w in words} == words


def test_dense_search_in_several_passes_with_fewer_vectors_than_asked(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    vectors = np.random.default_rng(1).normal(size=(9, 4)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    got = {(r.query_id, r.id) for r in retrieval.dense(df, df.where("id < 5").withColumnRenamed("id", "query_id"), 20).collect()}
    assert got == {(q, i) for q in range(5) for i in range(9)}


def test_focus_keeps_the_best_paragraphs_in_order(spark):
    text = "\n\n".join(["Loans grew in every district, the survey of the banks says.", "Nothing of interest was said about the weather this year.", "Bank loans to firms fell, bank loans to households rose again."])
    got = retrieval.focus(spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, text string"), "bank loans", 130).collect()
    assert [(r.at, r.gap) for r in sorted(got, key=lambda r: r.at)] == [(0, False), (2, True)]


def test_vectors_are_merged_by_text(spark):
    corpus = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "id long, text string")
    known = spark.createDataFrame([("86f7e437faa5a7fce15d1ddcb9eaeaea377667b8", [1.0])], "hash string, vector array<double>")
    todo = retrieval.unknown_texts(corpus, known).collect()
    assert [r.id for r in todo] == [1]
    fresh = spark.createDataFrame([(todo[0].hash, [2.0])], "hash string, vector array<double>")
    assert {r.id: r.vector for r in retrieval.merged_vectors(corpus, known, fresh).collect()} == {0: [1.0], 1: [2.0], 2: [1.0]}
    with pytest.raises(ValueError):
        retrieval.merged_vectors(corpus, known, fresh.limit(0))
