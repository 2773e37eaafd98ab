from pyspark.sql import functions as F

from weighbridge.operators import candidates

LABELS = "label_id long, note_id long, mention string, start long, end long, kind string, extra string"


def test_each_label_is_a_request_or_rejected_once(spark):
    notes = spark.createDataFrame([(1, "He has a headache today, no fever.", "s1"), (2, "x" * 500 + " ache " + "y" * 500, "s2"), (3, None, "s3"), (4, "a" * 400, "s1")], "note_id long, text string, subject string")
    rows = [
        (1, 1, "headache", 9, 17, "symptom", "k"), (2, 1, "headache", 10, 18, "symptom", "k"), (3, 9, "x", 0, 1, "symptom", "k"), (4, 3, "x", 0, 1, "symptom", "k"), (5, 1, "", 5, 5, "symptom", "k"),
        (6, 1, "fever.", 28, 34, "finding", "k"), (7, 1, "fever.", 28, 35, "finding", "k"), (8, 1, "He", 0, 2, "other", "k"), (9, 1, "He", -1, 1, "symptom", "k"), (10, 2, "ache", 501, 505, "symptom", "k"), (11, 4, "a" * 300, 0, 300, "symptom", "k"), (12, 1, None, 0, 2, "symptom", "k"), (13, 1, "He", None, 2, "symptom", "k"), (14, 1, "He", 0, 2, None, "k"),
    ]
    fine, bad = candidates.prepare(spark.createDataFrame(rows, LABELS), notes, ("symptom", "finding"), 60, ("<T>", "</T>"), "set")
    found = {r.label_id: r for r in fine.collect()}
    assert found[1].context == "He has a <T>headache</T> today, no fever." and found[6].context.endswith("<T>fever.</T>")
    assert len(found[10].context) == 60 + 7 and "<T>ache</T>" in found[10].context and found[1].subject_cluster == found[6].subject_cluster != found[10].subject_cluster
    reasons = {r.label_id: r.reason for r in bad.collect()}
    span, out = "span differs from its mention", "span outside the note"
    assert reasons == {2: span, 3: "missing note", 4: "missing note", 5: out, 7: out, 8: "unknown kind", 9: out, 11: "span over the window", 12: span, 13: out, 14: "unknown kind"}
    assert set(found) | set(reasons) == set(range(1, 15)) and "extra" in fine.columns and len({r.request_id for r in found.values()}) == 3


def test_fingerprints_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(i % 3, f"line {i}") for i in range(50)] + [(0, "line 0")], "k int, line string")
    n, digest = candidates.fingerprint(F.col("line"))
    got = [sorted(map(tuple, frame.groupBy("k").agg(n, digest).collect())) for frame in (rows, rows.orderBy(F.desc("line")).repartition(7))]
    assert got[0] == got[1] and len({g[2] for g in got[0]}) == 3
