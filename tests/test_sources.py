"""Readers on damaged files."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import cleaning
from tracewarden.schemas import FLAT_COLUMNS
from tracewarden.sources import audit_csv, audit_json, tables

HEADER = ",".join(FLAT_COLUMNS)


def line(**values):
    return ",".join('"' + str(values.get(c, "")).replace('"', '""') + '"' for c in FLAT_COLUMNS)


def test_damaged_csv(spark, tmp_path):
    good = line(Timestamp="2025-07-10T20:01:41Z", TransactionID="t1", RequestMethod="get", RequestBody='a\n"b",c', IsXMLBody="TRUE", PathLength="7", AIVerdictLabel="benign")
    rows = [
        HEADER,
        good,
        good.replace("TRUE", "True"),
        line(Timestamp="2025-07-10T20:01:42Z", TransactionID="t2", IsXMLBody="false")[:-3],
        line(TransactionID="long") + ",x,y",
        '2025-07-10T20:01:43Z,"half a rowCSV writer error: short write',
        "2025/07/10 20:01:44 Failed to write CSV record: short write",
        "an error,t3",
    ]
    (tmp_path / "a.csv").write_bytes(("\n".join(rows) + "\n").encode() + b'2025-07-10T20:01:45Z,t4\xff,10.0.0.1\n')
    (tmp_path / "only-header.csv").write_text(HEADER + "\n")
    (tmp_path / "empty.csv").write_text("")
    df = audit_csv.read_audit_csv(spark, [f"file://{tmp_path}/*.csv", f"file://{tmp_path}/missing.csv"])
    got = {(r["TransactionID"], r["IsXMLBody"], r["RequestBody"], r["PathLength"]) for r in df.collect()}
    assert got == {("t1", True, 'a\n"b",c', 7), ("t2", False, None, None), ("t3", None, None, None), ("t4", None, None, None)}
    assert df.count() == 5
    assert df.filter("TransactionID = 't1'").first()["Timestamp"].year == 2025
    assert audit_csv.read_audit_csv(spark, [f"file://{tmp_path}/none.csv"]).count() == 0


def test_records_across_splits(spark, tmp_path):
    """A body of many lines, read in splits far smaller than a record."""
    body = "\n".join(f'line {i} "quoted", with comma' for i in range(400))
    rows = [HEADER] + [line(TransactionID=f"t{i}", RequestBody=body, PathLength=str(i)) for i in range(20)]
    (tmp_path / "big.csv").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = audit_csv.read_audit_csv(spark, f"file://{tmp_path}/big.csv")
        got = {r["TransactionID"]: r["RequestBody"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"t{i}": body for i in range(20)}


def plain_records(lines):
    """The records of a log read from start to end: a damaged one loses its first line, and reading goes on behind it."""
    at, out = 0, []
    while at < len(lines):
        state, last = audit_csv._line_end(lines[at], False), at
        while state == "in" and last + 1 < len(lines):
            last += 1
            state = audit_csv._line_end(lines[last], True)
        if last == at and state != "in":
            out.append(lines[at])
        elif state == "out":
            out.append("\n".join(lines[at : last + 1]))
        else:
            last = at
        at = last + 1
    return [r for r in out if r]


@pytest.mark.parametrize("size", [23, 90, 10_000])
def test_records_of_damaged_logs_in_splits_of_any_size(spark, tmp_path, size):
    rng = random.Random(size)
    kinds = ['a,b', 'x,"q",y', 'k,"open', 'more', 'end",z', 'half "quote,r', '"', '""', 'e,"",f', 't"u', '"a""b",c', "", 'm,"n"o']
    weights = [6, 4, 2, 4, 2, 1, 1, 1, 1, 1, 1, 1, 1]
    want = []
    for number in range(4):
        lines = rng.choices(kinds, weights, k=60)
        (tmp_path / f"{number}.csv").write_text("\n".join(lines) + "\n")
        want += [(f"{number}.csv", r) for r in plain_records(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        records = audit_csv._records(audit_csv._lines(spark, [f"{tmp_path}/*.csv"]))  # the log is read here
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    records = records.collect()
    assert Counter((os.path.basename(r["file"]), r["text"]) for r in records) == Counter(want)


def test_stray_quotes_lose_one_record_only(spark, tmp_path):
    rows = [line(TransactionID=f"t{i}", RequestBody=f"b{i}\nsecond", PathLength=str(i)) for i in range(300)]
    rows[7] = '2025-07-10T20:01:41Z,"t7,10.0.0.1'
    rows[150] = '2025-07-10T20:01:41Z,"t150'
    rows[299] = '2025-07-10T20:01:41Z,"t299'
    (tmp_path / "stray.csv").write_text("\n".join([HEADER, *rows]) + "\n" + HEADER + "\n")
    for size in ("9000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [r["TransactionID"] for r in audit_csv.read_audit_csv(spark, f"{tmp_path}/stray.csv").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        # the header repeated as the last line is a row like any other
        assert sorted(got) == sorted([f"t{i}" for i in range(300) if i not in (7, 150, 299)] + ["TransactionID"])


def test_pretty_json(spark, tmp_path):
    def record(name, **calc):
        return json.dumps(
            {"transaction_id": name, "request": {"method": "GET", "body": "a\n}\nb", "headers": {"user_agent": "x", "other_headers": {"H": ["1", "2"]}}},
             "waf_processing": {"matched_rules": [{"rule_id": "1", "message": "m", "tags": ["a", "b"]}], "ai_score": 0.5}, "calculated_fields": calc},
            indent=1,
        )

    text = "2025/07/10 20:01:40 INFO: started\n2025/07/10 20:01:41 " + record("t1", query_ength=3) + "\n2025/07/10 20:01:42 " + record("t2", query_length=4) + "\n"
    (tmp_path / "log.json").write_text(text)
    nested = audit_json.read_audit_json(spark, f"file://{tmp_path}/log.json")
    flat = {r["TransactionID"]: r for r in audit_json.flatten_audit(nested).collect()}
    assert {k: v["QueryLength"] for k, v in flat.items()} == {"t1": 3, "t2": 4}
    assert flat["t1"]["OtherHeaders"] == "H:1,2" and flat["t1"]["MatchedRulesTags"] == "a;b" and flat["t1"]["RequestBody"] == "a\n}\nb"
    back = audit_json.nest_audit(audit_json.flatten_audit(nested))
    assert back.filter("transaction_id = 't1'").first()["request"]["headers"]["other_headers"] == {"H": ["1", "2"]}


def test_empty_clean_table_is_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], "a string")
    assert tables.write_clean(empty, f"file://{tmp_path}/clean", "20250101_000000") is None


def test_clean_steps_on_missing_columns(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert cleaning.clean_audit(df).count() == 1
    assert cleaning.fill_defaults(df, ["n"], ["t"], []).first().asDict() == {"a": "x", "n": 0, "t": ""}


def test_traversal_patterns(spark):
    df = spark.createDataFrame([("..\\x",), ("%2E%2E%2Fa",), ("a/b",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.is_traversal(F.col("t"))).collect()] == [True, True, False, False]


def test_missing_model(spark):
    from tracewarden.operators.models import load_model

    with pytest.raises(FileNotFoundError):
        load_model(spark, "/tmp/no-such-model-anywhere")


def test_csv_columns_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"ClientIP","Unknown","TransactionID"\r\n1.2.3.4,x,t1\r\n,y,"t,2"\r\n')
    (tmp_path / "b.csv").write_text("TransactionID,RequestBody\nt3,\"two\nlines\"\n")
    (tmp_path / "c.csv").write_text("TransactionID,ClientIP\n")
    (tmp_path / "d.csv").write_text("")
    rows = audit_csv.read_audit_csv(spark, f"{tmp_path}/*.csv")
    assert rows.columns == FLAT_COLUMNS
    got = sorted(tuple(r) for r in rows.select("TransactionID", "ClientIP", "RequestBody").collect())
    assert got == [("t,2", None, None), ("t1", "1.2.3.4", None), ("t3", None, "two\nlines")]
    (tmp_path / "odd.log").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        audit_csv.read_audit_csv(spark, f"{tmp_path}/odd.log")


@pytest.mark.parametrize("chunk", [1, 17, 60])
def test_records_of_damaged_logs_in_chunks_of_a_split(spark, tmp_path, monkeypatch, chunk):
    """A task used to hold all lines of a split and all records made of them (F16)."""
    import pyarrow as pa

    monkeypatch.setattr(audit_csv, "CHUNK_CHARS", chunk, raising=False)
    lines = ['a,b', 'x,"q",y', 'k,"open', "more", 'end",z', '"', "", 'é,"ü', '""', 't"u', 'm,"n"o'] * 12
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    records = audit_csv._records(audit_csv._lines(spark, [f"{tmp_path}/a.csv"])).collect()
    assert Counter(r["text"] for r in records) == Counter(plain_records(lines))
    batch = pa.record_batch([pa.array(["f"] * len(lines)), pa.array([40] * len(lines), pa.int64()), pa.array(lines)], ["file", "block", "value"])
    made = [p for b in audit_csv._split_pieces(chunk)(iter([batch])) for p in b.to_pylist()]
    starts = [p["block"] for p in made if p["role"] == "summary"]
    assert starts == sorted(set(starts)) and starts[0] == 40 and len(starts) > 1
    assert starts[-1] < 40 + len("\n".join(lines).encode())
    assert max(len(p["text"] or "") for p in made) <= chunk + max(map(len, lines)) + 1


def test_partitioned_log_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Rows used to be sorted by label before they were written, a task's rows at once (F27)."""
    from pyspark.sql.readwriter import DataFrameWriter

    setting, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.csv
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, path: (seen.append(int(spark.conf.get(setting))), write(self, path))[1])
    rows = spark.range(2000).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'malicious' END AS label", "concat('b\n\"', id) AS body")
    before = spark.conf.get(setting)
    path = audit_csv.write_audit_csv(rows, str(tmp_path / "log"), "20250710", "label")
    assert seen == [audit_csv.OPEN_FILES] and spark.conf.get(setting) == before
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert sorted((int(r["id"]), r["label"], r["body"]) for r in back.collect()) == [(r["id"], r["label"], r["body"]) for r in rows.orderBy("id").collect()]
