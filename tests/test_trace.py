"""Value tracing over the payroll code base."""

import pytest
from payroll import JAVA, TS

from lithic.operators import deep, symbols, trace
from lithic.sources.tree import classify

GEN = "method:com.acme.hrms.service.MonthlyPayrollService#generatePayroll(Employee,int)"
NET = "method:src.lib.payroll#calculateNetSalary(Employee,number,number)"


def build(spark, files):
    df = spark.createDataFrame([(k, len(v), v) for k, v in files.items()], "path string, size bigint, text string")
    return trace.TraceModel.build(deep.model(symbols.parse(classify(df))))


@pytest.fixture(scope="module")
def java(spark):
    return build(spark, JAVA)


@pytest.fixture(scope="module")
def ts(spark):
    return build(spark, TS)


def values(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def test_java_classes(java):
    got = values(java.m.classes, "name", "stereotype", "table")
    assert {("Employee", "entity", "employees"), ("MonthlyPayrollService", "service", None), ("PayrollController", "controller", None)} <= got


def test_java_interface_has_two_implementations(java):
    impl = trace.implementations(java.m)
    assert values(impl.filter("fqn like '%PayrollService'"), "impl") == {
        "com.acme.hrms.service.MonthlyPayrollService", "com.acme.hrms.service.PayrollPreviewService",
    }


def test_java_backward_reaches_the_column(java):
    out = java.explain(GEN, "netSalary")
    assert ("column", "employees.monthly_salary") in values(out["origins"], "kind", "value")
    texts = values(out["formulas"], "text")
    assert "netSalary = grossSalary - deductions" in texts
    assert "dailySalary = monthlySalary / WORKING_DAYS" in texts
    assert "days < 20" in values(out["conditions"], "condition")
    assert out["steps"].filter("line is null or confidence is null").isEmpty()


def test_java_forward_reaches_table_and_response(java):
    got = values(java.sinks(java.forward(GEN, "grossSalary")), "kind", "target")
    assert {("persisted", "payroll.gross_salary"), ("response-field", "PayrollResponse.gross")} <= got


def test_java_flows_keep_saving_and_preview_apart(java):
    flows = java.investigate("payroll").collect()
    assert len(flows) >= 2
    assert {f["persists"] for f in flows} == {True, False}
    assert any(f["preview"] and not f["persists"] for f in flows)
    assert all(0.4 <= f["confidence"] <= 0.98 for f in flows)
    assert any("employees.monthly_salary" in f["columns"] for f in flows)


def test_java_loose_ends_and_endpoints(java):
    ends = values(java.loose_ends(), "kind", "symbol")
    assert ("calculated-unused", "unusedTotal") in ends
    assert ("persisted-not-exposed", "Employee.auditPenalty") in ends
    assert ("calculated-unused", "grossSalary") not in ends
    assert ("POST", "/api/payroll/{id}") in values(java.cross_layer(), "http", "path")


def test_ts_formulas_and_origin(ts):
    out = ts.explain(NET, "net")
    texts = values(out["formulas"], "text")
    assert {"net = gross - deductions", "deductions = tax + penaltyAmount", "daily = monthly / WORKING_DAYS"} <= texts
    assert any(t.startswith("gross = daily × payableDays") for t in texts)
    assert ("column", "employees.monthly_salary") in values(out["origins"], "kind", "value")


def test_ts_ternary_guard(ts):
    d = ts.m.defs.filter("name = 'payable'").first()
    assert d["condition"] == "workedHours < HALF_DAY_THRESHOLD"


def test_ts_database_access(ts):
    got = {(r["table"], r["op"], tuple(r["columns"])) for r in ts.db.collect()}
    assert ("employees", "select", ("id", "monthly_salary")) in got
    assert ("payroll", "insert", ("net_salary", "employee_id")) in got


def test_ts_flow_persists_and_client_calls(ts):
    flows = ts.investigate("payroll").collect()
    assert any(f["persists"] and {"payroll.net_salary", "employees.monthly_salary"} <= set(f["columns"]) for f in flows)
    assert values(ts.frontend_calls().filter("endpoint is null"), "url") == {"/api/payroll/:id", "/api/missing"}


def test_client_call_meets_endpoint(spark):
    both = build(spark, {**JAVA, "src/ui/pay.tsx": TS["src/ui/pay.tsx"]})
    got = {r["url"]: r["endpoint"] for r in both.frontend_calls().collect()}
    assert got["/api/missing"] is None and "PayrollController" in got["/api/payroll/:id"]
