"""Validation of review payloads, and paths that must not leave a folder."""

import json
import posixpath

from kindred.operators import payloads

A = {"dataset": "d", "subject_id": "s", "session_id": None, "scan_uid": 5, "src_path": "/p/1"}
B = {"dataset": "e", "subject_id": "t", "scan_uid": "u", "src_path": "/p/2", "more": {"x": [1]}}


def test_first_fault_of_each_body(spark):
    good = {"a": A, "b": B, "qa_status": " Maybe ", "reason": " why "}
    bodies = [
        (1, json.dumps({"updates": [good, good | {"reason": None}], "x": 1}), None), (2, json.dumps({"updates": []}), None), (3, None, "Bad payload"), (4, "", "Bad payload"), (5, "{", "Bad payload"), (6, "[]", "Bad payload"),
        (7, '"updates"', "Bad payload"), (8, "{}", "Payload must contain list field 'updates'"), (9, '{"updates": null}', "Payload must contain list field 'updates'"), (10, '{"updates": "x"}', "Payload must contain list field 'updates'"),
        (11, json.dumps({"updates": [good, None]}), "Bad update at updates[1]"), (12, json.dumps({"updates": [[], good]}), "Bad update at updates[0]"), (13, json.dumps({"updates": [{"a": A}]}), "Bad pair payload at updates[0]"),
        (14, json.dumps({"updates": [good, {"a": A, "b": []}, 5]}), "Bad pair payload at updates[1]"), (15, json.dumps({"updates": [good | {"b": B | {"scan_uid": "N/A"}}]}), "Missing required fields in updates[0] (dataset/subject_id/scan_uid/src_path)"),
        (16, json.dumps({"updates": [good, good | {"qa_status": "sure"}]}), "Bad status in updates[1]"), (17, json.dumps({"updates": [{"a": A, "b": B}]}), "Bad status in updates[0]"), (None, "x", "Bad payload"),
    ]
    df = spark.createDataFrame([(i, b, 0) for i, b, _ in bodies], "id long, body string, idx int")
    got = {r.id: r.error for r in payloads.payload_errors(df, "id", "body").collect()}
    assert got == {i: e for i, _, e in bodies if e}
    rows = [r.asDict() for r in payloads.updates(df, "id", "body").orderBy("id", "idx").collect()]
    assert [(r["id"], r["idx"], r["qa_status"], r["reason"]) for r in rows] == [(1, 0, "maybe", "why"), (1, 1, "maybe", "")]
    assert (rows[0]["scan_uid_1"], rows[0]["session_id_1"], rows[0]["session_id_2"], rows[0]["path_2"]) == ("5", "", "", "/p/2")
    assert payloads.payload_errors(df.where("false"), "id", "body").count() == payloads.updates(df.where("false"), "id", "body").count() == 0


def test_paths_stay_inside(spark):
    paths = ["/data/x", "/data", "/data/../etc", "x/../../y", "../data/z", "a/./b", "/database", "/data/a/../../data/b", "", None, "/..//data/q", "..", ".", "//data//r/"]
    got = [r.ok for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", payloads.inside("p", "/data/").alias("ok")).orderBy("i").collect()]
    plain = lambda p: bool(p) and ("/" + posixpath.normpath(posixpath.join("/data", p)).lstrip("/") + "/").startswith("/data/")
    assert got == [plain(p) for p in paths]
