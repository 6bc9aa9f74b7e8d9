"""First-match-wins rule chains and classifiers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithic.functions import patterns as P
from lithic.functions.text import base_name, lc


def first_match(rules: list[tuple[Column, str]], default: str | None) -> Column:
    out = None
    for cond, value in rules:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def layer_of(path: Column) -> Column:
    p = F.lower(path)
    return first_match([(p.rlike(rx), name) for name, rx in P.LAYERS], "other")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(P.TEST_PATH)


def is_capability_test(path: Column) -> Column:
    return F.lower(path).rlike(P.CAPABILITY_TEST_PATH)


def is_product_test(path: Column) -> Column:
    return F.lower(path).rlike(P.PRODUCT_TEST_PATH)


def is_doc(path: Column) -> Column:
    return F.lower(path).rlike(P.DOC_PATH)


def is_metric_entrypoint(path: Column) -> Column:
    return F.lower(path).rlike(P.METRIC_ENTRYPOINT)


def is_core_entrypoint(path: Column) -> Column:
    return F.lower(path).rlike(P.CORE_ENTRYPOINT)


def is_write(kind: Column, op: Column, ddl: bool = True) -> Column:
    """Whether a database hit writes. Schema definition counts unless `ddl` is off."""
    text = F.concat(lc(kind), F.lit(" "), lc(op))
    return text.rlike(P.WRITE_WITH_DDL if ddl else P.WRITE_WITHOUT_DDL)


def lifecycle_stage(kind: Column, op: Column) -> Column:
    """ddl, create, update, delete or read. A raw SQL write of unknown verb counts as an update."""
    text = F.concat(lc(kind), F.lit(" "), lc(op))
    return first_match(
        [
            (text.rlike("ddl"), "ddl"),
            (text.rlike("insert|create|save|add"), "create"),
            (text.rlike("update|upsert|patch|set|sql-write"), "update"),
            (text.rlike("delete|remove|destroy"), "delete"),
        ],
        "read",
    )


def infra_rule(path: Column) -> tuple[Column, Column]:
    base = base_name(path)
    conds = [(path.rlike(rx) if rx else base.rlike(bx), kind, system) for rx, bx, kind, system in P.INFRA]
    return (
        first_match([(c, kind) for c, kind, _ in conds], None),
        first_match([(c, system) for c, _, system in conds], None),
    )


def confidence_word(c: Column) -> Column:
    return first_match([(c >= 0.75, "confident"), (c >= 0.5, "likely"), (c >= 0.28, "possibly")], "low")


def confidence_prefix(c: Column) -> Column:
    return first_match([(c >= 0.75, ""), (c >= 0.5, "Likely"), (c >= 0.28, "Possibly")], "Unable to determine")


def confidence_band(c: Column) -> Column:
    return first_match([(c >= 0.75, "high"), (c >= 0.5, "medium")], "low")


def complexity_band(c: Column) -> Column:
    return first_match([(c > 20, "high"), (c > 10, "moderate")], "low")


# Question wording -> kind of evidence wanted, first match wins.
QUESTION_OPS = [
    ("db-write", r"where.*(write|save|store|insert|persist)|written to|writes? to|store data"),
    ("db-read", r"where.*(read|fetch|load|query)|reads? from"),
    ("auth", r"how.*(auth|login|sign)"),
    ("compute", r"where.*(calcul|comput|generat)"),
    ("notify", r"how.*(email|notif|sms|sent|send)"),
    ("cache", r"how.*(cache|caching)"),
    ("integration", r"external|third.?party|integrat|api call"),
    ("uses", r"touch|use|using|depend"),
    ("security", r"security|secure|vulnerab|permission"),
    ("performance", r"performance|slow|bottleneck|hot path"),
]


def question_op(question: Column) -> Column:
    q = F.lower(question)
    return first_match([(q.rlike(rx), op) for op, rx in QUESTION_OPS], "general")
