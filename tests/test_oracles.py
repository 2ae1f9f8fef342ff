"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from attestor.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(([norm(r[i]) for i in order] for r in result.fetchall()), key=str)
    found = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=str)
    assert found == expected


#: What the queries without SQL must return: the rows and the columns that identify them.
ROWS = {
    "prevalence_crossfit": (None, ["fold", "label", "pattern"]),
    "logistic_stacker": (None, ["fold", "label", "pattern"]),
    "paired_bootstrap": (3, ["model_a", "model_b"]),
    "crossfit_against_baselines": (6, ["baseline"]),
    "paired_binary": (6, ["metric", "baseline"]),
    "bootstrap_ci": (1, ["repetitions"]),
    "grouped_folds": (None, ["dataset", "family"]),
    "grouped_crossfit": (None, None),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    """Its rows are there, once each, the same in a second run; what they say is tested by operator."""
    most, keys = ROWS[name]
    found = [catalogue.queries()[name](spark, SF) for _ in range(2)]
    rows = [sorted(map(repr, df.collect())) for df in found]
    assert rows[0] == rows[1] and rows[0]
    if most:
        assert len(rows[0]) == most
    if keys:
        assert found[0].select(*keys).distinct().count() == len(rows[0])


def test_folds_hold_families_whole(spark):
    from attestor.functions import scalar

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    families = {r.f for r in docs.select(scalar.lexical_family(docs.text).alias("f")).collect()}
    found = catalogue.queries()["grouped_folds"](spark, SF).collect()
    assert {r.family for r in found} == families and {r.fold for r in found} == set(range(5))


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 6
    assert {"system", "f1", "macro_f1", "mcc"} <= set(df.columns)
