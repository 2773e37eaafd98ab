import csv
import gzip
import json
import random

import pytest

from weighbridge.sources import files, shared, splits


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    r = random.Random(1)
    want = {}
    for name in ("b.txt", "a.txt", "c.txt"):
        rows = ["x" * r.choice([0, 3, 40, 900]) + str(i) for i in range(300)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want |= {(name, n + 1): v for n, v in enumerate(rows)}
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("one\ntwo\r\nthree")
    want |= {("d.txt.gz", n + 1): v for n, v in enumerate(["one", "two", "three"])}
    got = splits.numbered(spark, str(tmp_path)).collect()
    assert {(x.path.rsplit("/", 1)[1], x.line): x.value for x in got} == want and len(got) == len(want)
    assert [x.value for x in sorted(got, key=lambda x: x.ordinal)] == [want[k] for k in sorted(want)]
    assert sorted(x.ordinal for x in got) == list(range(len(want)))
    sizes = [x["count"] for x in splits.batched(splits.numbered(spark, str(tmp_path))).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [128] * (len(want) // 128) + [len(want) % 128]


def test_bad_json_lines_are_named(spark, tmp_path, small_splits):
    good = [json.dumps({"k": i, "t": "a" * (i % 50)}) for i in range(200)]
    bad = good[:150] + ["", "  ", '{"k": 1', "[1, 2]", "3"] + good[150:]
    (tmp_path / "x.jsonl").write_text("\n".join(bad) + "\n")
    found = splits.judged_lines(splits.numbered(spark, str(tmp_path))).where("problem is not null").orderBy("line").collect()
    assert [(x.line, x.problem) for x in found] == [(153, "invalid JSON"), (154, "expected a JSON object"), (155, "expected a JSON object")]
    with pytest.raises(Exception, match=r"x\.jsonl:15[345]: "):
        splits.read_json_lines(spark, str(tmp_path), "k long, t string").collect()
    (tmp_path / "x.jsonl").write_text("\n".join(good) + "\n")
    got = splits.read_json_lines(spark, str(tmp_path), "k long, t string").orderBy("ordinal").collect()
    assert [x.k for x in got] == list(range(200)) and [x.line for x in got] == list(range(1, 201))


def serial(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [(n, [v if v is not None else "" for v in row.values()]) for n, row in enumerate(csv.DictReader(f), start=2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_quoted_csv_over_splits_equals_a_serial_reader(spark, tmp_path, small_splits, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    r = random.Random(2)
    field = lambda: "".join(r.choice(["a", "é", ",", '"', "\n", "\r\n", " ", '""', "\n\n", "word " * 9]) for _ in range(r.choice([0, 1, 5, 30])))
    want = []
    for k, name in enumerate(("one.csv", "two.csv")):
        with open(tmp_path / name, "w", encoding="utf-8-sig" if k else "utf-8", newline="") as f:
            w = csv.writer(f, lineterminator="\r\n" if k else "\n")
            w.writerow(["id", "text, of it", "more"])
            for i in range(150):
                w.writerow([i, field() if i != 70 else "\n".join(["deep, \"inside\""] * 400), field()])
                if i % 40 == 0:
                    f.write("\n")
        want += [(name, n, v) for n, v in serial(tmp_path / name)]
    rows = splits.read_csv(spark, str(tmp_path), places=True)
    assert rows.columns == ["_path", "_row", "_line", "id", "text, of it", "more"]
    got = sorted((x._path.rsplit("/", 1)[1], x._row, list(x[3:])) for x in rows.collect())
    assert got == sorted(want)


def test_quotes_that_stand_for_themselves(spark, tmp_path, small_splits):
    text = 'id,v,w\n1,5" pipe,x\n2, "not, quoted,y\n3,"a"b"c,z\n4,"q\n""r"" s",t\n5,short\n6,,\n' + "".join(f'{i},6" by 4",u\n' for i in range(7, 200)) + '200,"never, ends\nhere'
    (tmp_path / "x.csv").write_text(text)
    got = splits.read_csv(spark, str(tmp_path), places=True).orderBy("_row").collect()
    assert [(x._row, list(x[3:])) for x in got] == [(n, v[:3]) for n, v in serial(tmp_path / "x.csv")]
    lines = {x.id: x._line for x in got}
    assert lines["4"] == 5 and lines["5"] == 7 and got[-1].v == "never, ends\nhere"


def test_within():
    for line, start, end in [("", True, True), ("", False, False), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('"a""', False, True), ('"a"",b"', False, False), ('a"b', False, False), ('x","y', True, True)]:
        assert splits.within(line, start) is end


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError, match="repeats"):
        splits.read_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        splits.read_csv(spark, str(tmp_path))
    assert files.read_csv(spark, str(tmp_path / "b.csv"), ["B"]).collect()[0][0] == "2"
    (tmp_path / "c.csv").write_text("")
    assert splits.read_csv(spark, str(tmp_path / "c.csv")).count() == 0
