"""Files of capabilities: the right rows, made distinct before it is asked whether they are tests."""

import re

from lithic.operators.capability import evidence_files
from lithic.plans.warehouse import Warehouse


def test_users_of_matched_tables(spark, rows):
    ev = spark.createDataFrame(
        [("pay", "table", "payments", None, False), ("pay", "name", "a/pay.py", "a/pay.py", False), ("buy", "table", "payments", None, False)],
        "cap string, signal string, item string, file string, is_test boolean",
    )
    db = spark.createDataFrame(
        [("prisma", "findMany", "payments", "b/read.py"), ("sql-write", None, "payments", "b/read.py"), ("prisma", "create", "payments", "tests/test_pay.py"), ("prisma", "create", None, "c.py"), ("sql", None, "others", "d.py")],
        "kind string, op string, table string, file string",
    )
    found = evidence_files(ev, db)
    assert rows(found) == sorted(
        [("buy", "b/read.py", False), ("buy", "tests/test_pay.py", True), ("pay", "a/pay.py", False), ("pay", "b/read.py", False), ("pay", "tests/test_pay.py", True)], key=repr
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Pairs are made distinct by capability and file alone, before it is asked whether a file is a test.
    assert re.search(r"Aggregate \[(.*?)\]", plan)[1].count(",") == 1


def test_sizes_of_files_need_no_line_items(spark, rows):
    w = Warehouse(spark, "/root/testdata/sf0.001")
    assert rows(w.sizes) == rows(w.files.select("path", "loc"))
    assert "l_partkey" not in w.sizes._jdf.queryExecution().optimizedPlan().toString()
