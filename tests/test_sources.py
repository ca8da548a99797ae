"""File formats and folder layouts."""

import json
import tempfile
from pathlib import Path

import pytest

from vigilframe.sources import readers as S


@pytest.fixture
def root():
    return Path(tempfile.mkdtemp(prefix="spark-vf-test-"))


def test_json_shapes(spark, root):
    rec = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    shapes = {"array": rec, "records": {"records": rec}, "data": {"data": rec, "n": 2}, "items": {"items": rec}, "single": rec[0]}
    for name, doc in shapes.items():
        (root / f"{name}.json").write_text(json.dumps(doc))
        got = sorted(r["a"] for r in S.load_records(spark, str(root / f"{name}.json")).collect())
        assert got == ([1] if name == "single" else [1, 2]), name
    with pytest.raises(ValueError):
        S.load_records(spark, str(root / "x.xlsx"))


def test_blank_lines_in_detections(spark, root):
    (root / "d.jsonl").write_text('{"window_id": 1}\n\n{"window_id": 2}\n')
    assert S.read_detections(spark, str(root / "d.jsonl"), "window_id long").count() == 2


def test_discovery_prefers_names_in_order(spark, root):
    for n in ("a.csv", "sub/B.CSV", "sub/c.csv"):
        (root / n).parent.mkdir(exist_ok=True)
        (root / n).write_text("x\n1\n")
    found = S.find_csv(spark, str(root), ["C.csv", "A.csv"])
    assert [p.rsplit("/", 1)[1] for p in found] == ["c.csv", "a.csv"]
    with pytest.raises(ValueError):
        S.single_csv(spark, str(root))


def test_folder_labels(spark, root):
    for folder, n in (("Regular", 3), ("Ip Spoofing", 2)):
        (root / folder).mkdir()
        (root / folder / "f.csv").write_text("ts,v\n" + "".join(f"{i},{i}\n" for i in range(n)))
    rows, counts = S.folder_labelled(spark, str(root), {"Regular": "benign", "Ip Spoofing": "ip_spoofing"}, "ts long, v long")
    assert {(r["label"], r["rows"]) for r in counts.collect()} == {("benign", 3), ("ip_spoofing", 2)}
    with pytest.raises(ValueError):
        S.folder_labelled(spark, str(root), {"Regular": "benign"}, "ts long, v long")


def test_folder_header_mismatch_is_an_error(spark, root):
    (root / "Regular").mkdir()
    (root / "Regular" / "f.csv").write_text("ts,w\n1,2\n")
    with pytest.raises(Exception):
        S.folder_labelled(spark, str(root), {"Regular": "benign"}, "ts long, v long")[0].collect()


def test_malformed_tail(spark, root):
    (root / "f.csv").write_text("a,b\n1,2\n3,4\n5\n7,8\n")
    got = S.truncate_malformed(spark, str(root / "f.csv"), "a long, b long").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (3, 4)]


def test_header_union(spark, root):
    for d, text in (("x", "a,b\n1,2\n"), ("y", "b,c\n3,4\n"), ("z", "a,b\n5,6\n")):
        (root / d).mkdir()
        (root / d / "f.csv").write_text(text)
    got = S.header_union_files(spark, str(root))
    assert sorted((r["source_folder"], r["a"], r["b"], r["c"]) for r in got.collect()) == [
        ("x", "1", "2", None), ("y", None, "3", "4"), ("z", "5", "6", None)]


def test_reports_flatten_to_dotted_columns(spark, root):
    for d, doc in (("r1", {"ood": {"auroc": 0.5}, "n": 1}), ("r2", {"ood": {"auroc": 0.7, "f1": 0.1}})):
        (root / d).mkdir()
        (root / d / "eval_report.json").write_text(json.dumps(doc))
    got = S.read_reports(spark, str(root))
    assert set(got.columns) == {"run", "ood.auroc", "ood.f1", "n"} and got.count() == 2
