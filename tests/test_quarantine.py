"""Planted bad rows land in the rejects with their reasons; nothing is lost."""

import tempfile

from creditline.sources.quarantine import Rule, accepted, checked, rejected, rejects_report, write_quarantined

RULES = {"id": Rule("bigint"), "day": Rule("date"), "amount": Rule("decimal(10,2)", required=False, minimum=0), "kind": Rule("string", values=("A", "b"))}
ROWS = [("1", "2024-01-01", "1.50", "a", "x"), (" 2 ", "2024-01-02", None, " B ", "x"), ("3", "2024-01-03", "", "A", "x"),
        ("4.5", "2024-01-01", "1", "a", "x"), (None, "2024-02-30", "1", "a", "x"), ("6", "soon", "-1", "c", "x"), ("7", "2024-01-01", "1e3", "a", "x"),
        ("99999999999999999999", "2024-01-01", "123456789.00", "", "x"), ("", "", "", None, None)]
REASONS = [None, None, None, "id: not a bigint", "id: missing; day: not a date", "day: not a date; amount: below 0; kind: not accepted", None,
           "id: not a bigint; amount: not a decimal(10,2); kind: missing", "id: missing; day: missing; kind: missing"]


def test_reasons_and_types(spark):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "n int, id string, day string, amount string, kind string, other string")
    rows = checked(raw, RULES)
    assert [r.reject_reason for r in rows.orderBy("n").collect()] == REASONS
    good = accepted(rows, RULES)
    assert dict(good.dtypes) == {"n": "int", "id": "bigint", "day": "date", "amount": "decimal(10,2)", "kind": "string", "other": "string"}
    assert [(r.id, str(r.day), r.amount and float(r.amount), r.kind) for r in good.orderBy("n").collect()] == [
        (1, "2024-01-01", 1.5, "a"), (2, "2024-01-02", None, "B"), (3, "2024-01-03", None, "A"), (7, "2024-01-01", 1000.0, "a")]
    bad = rejected(rows)
    assert good.count() + bad.count() == len(ROWS)
    assert {r.id for r in bad.collect()} == {"4.5", None, "6", "99999999999999999999", ""}  # as they came
    report = {r.reason: r.rows for r in rejects_report(rows).collect()}
    assert report["ok"] == 4 and report["day: not a date"] == 2 and report["id: missing"] == 2


def test_one_pass_write_missing_column_and_empty_table(spark):
    raw = spark.createDataFrame(ROWS, "id string, day string, amount string, kind string, other string")
    path = tempfile.mkdtemp(prefix="creditline-quarantine-", dir="/tmp") + "/out"
    write_quarantined(checked(raw, RULES), path)
    back = spark.read.parquet(path)
    assert {r.rejected: r["count"] for r in back.groupBy("rejected").count().collect()} == {'true': 5, 'false': 4}
    lacking = checked(raw.drop("day"), RULES)
    assert all("day: missing" in r.reject_reason for r in lacking.collect())
    assert accepted(checked(raw.limit(0), RULES), RULES).count() == 0
