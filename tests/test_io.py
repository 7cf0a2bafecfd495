import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tagloom.operators.contracts import Constraint, ContractError
from tagloom.session import Scratch
from tagloom.sources import readers, writers
from tagloom.streaming import monitor as M


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id":"x","n":1}\n\n{"id":"y","n":2}\n')
    assert readers.json_lines(spark, p, "id string, n int").count() == 2
    with pytest.raises(ContractError, match="blank"):
        readers.json_lines_no_blanks(spark, p, "id string, n int")
    bad = put(tmp_path / "b.jsonl", '{"id":"x"}\n{oops\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, bad, "id string, n int").collect()
    assert [(r.file, r.line, r.value) for r in readers.line_errors(spark, bad, "id string, n int").collect()] == [("b.jsonl", 2, "{oops")]
    with pytest.raises(ContractError):
        readers.json_object(put(tmp_path / "c.json", "[1]"))


def test_manifest(spark, tmp_path):
    p = put(tmp_path / "m.jsonl", '{"id":"x","n":1}\n{"id":"y","n":2}\n')
    sha = hashlib.sha256(open(p, "rb").read()).hexdigest()
    schema = "id string, n int"
    assert readers.manifest(spark, p, schema, "id", expected_sha256=sha).count() == 2
    with pytest.raises(ContractError, match="locked"):
        readers.manifest(spark, p, schema, "id", expected_sha256="0" * 64)
    with pytest.raises(ContractError, match="big"):
        readers.manifest(spark, p, schema, "id", [Constraint("big", F.col("n") > 1)])
    with pytest.raises(ContractError, match="keys"):
        readers.manifest(spark, put(tmp_path / "d.jsonl", '{"id":"x"}\n{"id":"x"}\n'), schema, "id")


def test_canonical_fields(spark):
    df = spark.createDataFrame([("", "r1", "p", None, 3)], "record_id string, id string, local_path string, image_hash string, other int")
    r = readers.canonical_fields(df).first()
    assert (r.record_id, r.image_path, r.sha256, r.phash64, r.other) == ("r1", "p", None, None, 3)


def test_inventory_and_checksums(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "s").mkdir(parents=True)
    put(root / "a.txt", "a")
    put(root / "s" / "b.txt", "b")
    n = writers.checksums(str(root), spark, str(tmp_path / "SUMS"))
    got = {r.path: r.sha256 for r in readers.checksum_file(spark, str(tmp_path / "SUMS")).collect()}
    assert n == 2 and got == {"a.txt": hashlib.sha256(b"a").hexdigest(), "s/b.txt": hashlib.sha256(b"b").hexdigest()}
    for line in ("0" * 64 + "  ../x", "0" * 64 + "  /x", "0" * 63 + "  x"):
        with pytest.raises(ContractError):
            readers.checksum_file(spark, put(tmp_path / "BAD", line + "\n"))
    writers.publish(str(root), str(tmp_path / "done"))
    with pytest.raises(FileExistsError):
        writers.publish(str(tmp_path / "done"), str(tmp_path / "done"))


def test_shards(spark, tmp_path):
    for r in range(2):
        put(tmp_path / f"test.rank{r:02d}-of-02.jsonl", json.dumps({"id": f"r{r}"}) + "\n")
    assert {(r.id, r.rank, r.world) for r in readers.shard_set(spark, str(tmp_path), "test", "id string").collect()} == {("r0", 0, 2), ("r1", 1, 2)}
    rows = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "c", 0), (1, "c", 2)], "rank int, id string, pos int")
    told = spark.createDataFrame([(0, 2, 2, "b", True), (2, 0, 0, None, True)], "rank int, durable_records int, next_local_index int, last_record_id string, complete boolean")
    bad = {(r.rank, r.name) for r in readers.sidecar_disagreements(rows, told, "id", "pos").collect()}
    assert bad == {(1, n) for n in ("sidecar", "durable_records", "next_local_index", "last_record_id", "distinct_keys", "complete", "contiguous")} - {(1, "x")}
    os.unlink(tmp_path / "test.rank01-of-02.jsonl")
    with pytest.raises(ContractError):
        readers.shard_set(spark, str(tmp_path), "test", "id string")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", [1, 2]), ("b", "val", [])], "id string, split string, l array<int>")
    writers.split_json(df, str(tmp_path / "j"))
    assert sorted(x for x in os.listdir(tmp_path / "j") if x.startswith("split")) == ["split=train", "split=val"]
    with pytest.raises(Exception):
        writers.split_json(df, str(tmp_path / "j"))
    writers.flat_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("id = 'a'").first().l == "[1,2]"
    writers.atomic_json({"b": 1}, str(tmp_path / "x.json"))
    assert readers.json_object(str(tmp_path / "x.json")) == {"b": 1} and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
    writers.atomic_json({"b": 2}, str(tmp_path / "x.json"))
    assert readers.json_object(str(tmp_path / "x.json")) == {"b": 2}
    for n in range(5):
        (tmp_path / "steps" / f"step-{n}").mkdir(parents=True)
    assert writers.keep_newest(str(tmp_path / "steps")) == ["step-0", "step-1"] and sorted(os.listdir(tmp_path / "steps")) == ["step-2", "step-3", "step-4"]


def test_scratch_survives_and_cleans(spark):
    s = Scratch(spark, "t")
    df = s.keep(spark.range(5).toDF("a"))
    assert df.count() == 5
    s.drop(df)
    s.close()


def test_slices_resume_and_drop_repeats(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id"), F.timestamp_seconds("id").alias("ts"))
    rows(0, 5).coalesce(1).write.parquet(src)
    ev = lambda: M.read_events(spark, src, "id long, ts timestamp")
    M.run_slice(ev(), out, chk, ["id"])
    assert spark.read.parquet(out).count() == 5
    rows(3, 8).coalesce(1).write.mode("append").parquet(src)
    M.run_slice(ev(), out, chk, ["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_latest_snapshot(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, t int").coalesce(1).write.parquet(src)
    M.latest_snapshot(spark.readStream.schema("k string, t int").parquet(src), str(tmp_path / "out"), str(tmp_path / "chk"), "k", "t")
    assert {(r.k, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 3), ("b", 2)}
