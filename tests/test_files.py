"""The sink of named files, readers of small files, and documents merged with their sources."""

import json

import pytest
from pyspark.sql import functions as F

from randaudit.operators import source_scan as scan
from randaudit.sources import contracts as src
from randaudit.sources import named_files


def files(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary")


def test_versions_are_added(spark, tmp_path):
    path = str(tmp_path / "sink")
    named_files.write(files(spark, [("b/vulnerable/a.sol", b"x\r\ny"), ("b/safe/c.sol", b"caf\xe9"), (None, b"z"), ("d.sol", None), ("b/safe/e.sol", b"")]), path)
    named_files.write(files(spark, [("b/safe/a.sol", b"new")]), path)
    named_files.write(files(spark, []), path)
    read = lambda v: {(r.contract_id, r.batch, r.label, r.code, r.encoding) for r in src.read_contracts(spark, named_files.folders(spark, path, v)).collect()}
    # A file of no bytes has nothing to scan.
    assert read(1) == {("a", "b", 1, "x\ny", "UTF-8"), ("c", "b", 0, "café", "ISO-8859-1")}
    assert read(2) == {("a", "b", 0, "new", "UTF-8")}
    assert read(None) == set()


@pytest.mark.parametrize("name", ["../up.sol", "folder/"])
def test_odd_names_fail_and_leave_no_version(spark, tmp_path, name):
    path = str(tmp_path / "sink")
    with pytest.raises(Exception, match="no name of a file"):
        named_files.write(files(spark, [("fine.sol", b"x"), (name, b"x")]), path)
    assert not (tmp_path / "sink" / named_files.COMMITS).exists()


def test_files_of_a_lost_attempt_are_not_listed(spark, tmp_path):
    path = str(tmp_path / "sink")
    named_files.write(files(spark, [("a.sol", b"x")]), path)
    stray = tmp_path / "sink" / "data-stray"
    stray.mkdir()
    (stray / "b.sol").write_bytes(b"y")
    assert [r.contract_id for r in src.read_contracts(spark, named_files.folders(spark, path)).collect()] == ["a"]


def test_abort_removes_what_tasks_wrote(tmp_path):
    writer = named_files.NamedFilesWriter(str(tmp_path))
    done = writer.write(iter([_Row("a.sol", b"x")]))
    assert (tmp_path / done.folder / "a.sol").read_bytes() == b"x"
    writer.abort([done, None])
    assert not (tmp_path / done.folder).exists()


class _Row:
    def __init__(self, name, content):
        self.name, self.content = name, content


def test_asts_of_all_kinds(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    texts = {"a": b'{"file_name": "x.sol", "v": 1}', "deep/b": b'{"v": "\xe9"}', "c": b"{broken", "d": b"[1]", "e": b"null", "f": b"7"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_bytes(text)
    (tmp_path / "other.txt").write_text("{}")
    found = src.read_asts(spark, str(tmp_path)).withColumn("v", F.try_variant_get("ast", "$.v", "string"))
    got = {r.file_name: (r.status, r.v) for r in found.collect()}
    assert got == {"x.sol": ("read", "1"), "b.sol": ("read", "é"), "c.sol": ("broken", None), "d.sol": ("no object", None), "e.sol": ("no object", None), "f.sol": ("no object", None)}
    listed = spark.createDataFrame([("x.sol",), ("gone.sol",)], "file_name string")
    assert {(r.file_name, r.status) for r in src.with_missing(listed, found, "file_name").collect()} == {("x.sol", "read"), ("gone.sol", "missing")}


def merged(spark, docs, codes, path, span):
    asts = src.parse_asts(spark.createDataFrame(docs, "path string, json string"))
    hits = scan.detect(spark.createDataFrame(codes, "contract_id string, code string"))
    summary = scan.statistics(hits).withColumnRenamed("contract_id", "file_name")
    src.write_merged(src.merge_sources(asts, hits.withColumnRenamed("contract_id", "file_name"), summary, span=span), path)
    found = src.read_merged(spark, path).select("file_name", "part", F.to_json("ast").alias("json"), F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("name"))
    return {(r.file_name, r.part): (json.loads(r.json), r.name) for r in found.collect()}


def test_documents_are_edited_in_place(spark, tmp_path):
    code = "contract C {\n" + "uint a = block.timestamp;\n" * 30 + "}"
    docs = [("in/a.json", '{"file_name": "a.sol", "sources": ["old"], "sourcesSummary": 3, "nodes": [{"id": 1.5, "name": "ü\\n"}], "nothing": null}'), ("in/b.json", '{"k": {"deep": [1, {}]}}'), ("in/c.json", "{broken")]
    got = merged(spark, docs, [("a.sol", code), ("b.sol", "no hits")], str(tmp_path / "out"), 300)
    first, name = got["a.sol", 0]
    assert name.endswith("in/a.json") and first["nodes"] == [{"id": 1.5, "name": "ü\n"}] and first["nothing"] is None
    parts = [got["a.sol", k][0] for k in range(len([1 for f, _ in got if f == "a.sol"]))]
    assert got["a.sol", 1][1].endswith("in/a.1.json") and len(parts) == 3
    positions = [s["position"] for p in parts for s in p["sources"]]
    assert positions == sorted(positions) and all(s["position"] // 300 == k for k, p in enumerate(parts) for s in p["sources"])
    assert first["sourcesSummary"]["total_sources"] == len(positions) == 31  # 30 tokens; of equal state variables the last
    assert first["sourcesSummary"]["by_type"] == {"timestamp": 31}
    assert {s["context"]["type"] for p in parts for s in p["sources"]} == {"function", "state"} and all(s["isSource"] for p in parts for s in p["sources"])
    assert got["b.sol", 0][0] == {"k": {"deep": [1, {}]}, "sources": [], "sourcesSummary": {"total_sources": 0, "by_type": {}, "by_risk": {}, "nested_sources": 0}}
    assert {f for f, _ in got} == {"a.sol", "b.sol"}


def test_folders_are_bounded_and_read_by_a_task_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "FOLDER_FILES", 2)
    monkeypatch.setattr(named_files, "FOLDER_BYTES", 100)
    writer = named_files.NamedFilesWriter(str(tmp_path))
    names = [*(f"deep/{k}.sol" for k in range(5)), "x.json", "_odd name.sol", "empty.sol"]
    done = writer.write(iter([_Row(n, b"" if n == "empty.sol" else (b"x" * 100 if n == "deep/2.sol" else n.encode())) for n in names]))
    assert done.files == 8 and [n for _, n in done.folders] == [2, 1, 2, 2, 1]
    writer.commit([done, None])
    found = named_files.read(spark, str(tmp_path), glob="*.sol")
    assert found.rdd.getNumPartitions() == 5
    got = {r.path.split("/", len(str(tmp_path).split("/")) + 1)[-1]: bytes(r.content) for r in found.collect()}
    assert got == {n: b"x" * 100 if n == "deep/2.sol" else n.encode() for n in names if n.endswith(".sol") and n != "empty.sol"}
    writer.abort([done, None])
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("data-")]


def test_the_driver_lists_no_merged_documents(spark, tmp_path):
    path = str(tmp_path / "sink")
    docs = [(f"in/{k}.json", "{}") for k in range(300)]
    asts = src.parse_asts(spark.createDataFrame(docs, "path string, json string"))
    hits = scan.detect(spark.createDataFrame([("none", "no hits")], "contract_id string, code string"))
    src.write_merged(src.merge_sources(asts, hits.withColumnRenamed("contract_id", "file_name"), scan.statistics(hits).withColumnRenamed("contract_id", "file_name")), path)
    read = src.read_merged(spark, path)
    assert read.inputFiles() == [] and read.rdd.getNumPartitions() == len(named_files.folders(spark, path))
    assert read.where("status = 'read'").count() == 300
    none = str(tmp_path / "none")
    named_files.write(files(spark, []), none)
    assert named_files.read(spark, none).count() == 0
