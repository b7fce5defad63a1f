"""Registered queries: names they use exist, and small tables give what their SQL gives."""

import ast
import datetime
import importlib
import pkgutil
from types import ModuleType

import duckdb
import pytest

import labelshift
from labelshift.registry import ORACLES, QUERIES


def modules():
    names = [m.name for m in pkgutil.walk_packages(labelshift.__path__, "labelshift.") if not m.ispkg]
    return [importlib.import_module(name) for name in names]


def test_modules_hold_what_is_read_from_them():
    missing = []
    for module in modules():
        with open(module.__file__, encoding="utf-8") as source:
            tree = ast.parse(source.read())
        for node in ast.walk(tree):
            if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
                held = getattr(module, node.value.id, None)
                if isinstance(held, ModuleType) and not hasattr(held, node.attr):
                    missing.append(f"{module.__name__}:{node.lineno} {node.value.id}.{node.attr}")
    assert not missing


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Customers and orders of seven years, both labels in each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    customers = [(k, k % 25, 900.0 + 37.0 * (k % 97)) for k in range(1, 200)]
    orders = [
        (k, 1 + k * 31 % 199, "P" if k % 3 else "O", 20000.0 + 613.0 * (k * 17 % 499), datetime.date(1995 + k % 7, 1 + k % 12, 5))
        for k in range(1, 6001)
    ]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(
        f"{folder}/customer.parquet"
    )
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"
    ).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["est2_selected_model", "rpt8_paired_comparison"])
def test_query_gives_what_its_sql_gives(spark, tables, name):
    connection = duckdb.connect()
    for table in ("customer", "orders"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    relation = connection.sql(ORACLES[name])
    columns = sorted(relation.columns)
    expected = sorted(relation.select(", ".join(columns)).fetchall())
    assert expected
    assert sorted(map(tuple, QUERIES[name](spark, tables).select(*columns).collect())) == expected
