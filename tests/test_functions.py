import pytest
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.functions import render


def col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_digests(spark):
    h = "ab" * 32
    assert col(spark, [h, h.upper(), f" sha256:{h}\n", "pending", "", None, h[:40], "g" * 64], N.sha256_hex) == [h, h, h, None, None, None, None, None]


def test_fingerprints(spark):
    got = col(spark, ["0XABC", "ffffffffffffffff", " 1 ", "failed", "", None, "0x", "1" * 17], N.phash_hex)
    assert got == ["0000000000000abc", "f" * 16, "0" * 15 + "1", None, None, None, None, None]
    assert col(spark, ["f" * 16, "7" + "f" * 15, "0"], N.phash_long) == [-1, 2**63 - 1, 0]


def test_paths(spark):
    same = ["img/a/1.png", "./img/a/1.png", "img\\a\\1.png", "img%2Fa%2f1.png", "img//a///1.png", "img/../img/a/1.png", " img/a/1.png\t", "img/a/1.png?v=3", "img/./a/b/../1.png"]
    assert set(col(spark, same, N.image_path)) == {"img/a/1.png"}
    assert col(spark, ["n/a", "-", "  ", None, "none", "../x"], N.image_path) == [None] * 5 + ["../x"]


def test_record_names(spark):
    assert set(col(spark, ["SF-00001", "sf 1", "SF_1", "SF00001", " sf-1 "], N.record_name)) == {"SF-1"}
    assert col(spark, ["none", "", None, "SF-10", "weird/7"], N.record_name) == [None, None, None, "SF-10", "WEIRD/7"]


@pytest.mark.parametrize("big", [False, True])
def test_label_indices(spark, big):
    lookup = {"a": 2, "b": 0, "alias a": 2} | ({f"x{i}": 9 for i in range(N.MAP_LIMIT)} if big else {})
    values = [["a", " b　", "alias a", "other", None], [], None, ["\xa0a\t"]]
    assert col(spark, values, lambda c: N.label_indices(c, lookup), "array<string>") == [[0, 2], [], [], [2]]


def test_two_decimals_round_the_exact_value(spark):
    values = [0.125, 0.375, 0.005, 0.015, 1.005, 0.999, -0.2, 1.7, 0.285]
    assert col(spark, values, lambda c: render.two_decimals(c), "double") == [f"{min(1, max(0, v)):.2f}" for v in values]


def test_texts(spark):
    assert col(spark, [0, 59, 61, 3600, 360000, -5], render.duration_text, "int") == ["00:00", "00:59", "01:01", "01:00:00", "100:00:00", "00:00"]
    assert col(spark, [9.94, 10.0, 1234.6], render.cpu_text, "double") == ["9.9% CPU", "10% CPU", "1235% CPU"]
    got = col(spark, ["2026-07-17T10:00:00+08:00", "2026-07-17T02:00:00Z", "2026-07-17T02:00:00", "x", None], render.offset_timestamp)
    assert got[0] == got[1] and got[2:] == [None] * 3


def test_aspect(spark):
    df = spark.createDataFrame([(79, 100), (80, 100), (125, 100), (126, 100), (1, 0), (None, 1)], "w int, h int")
    assert [r[0] for r in df.select(render.aspect_bucket(F.col("w"), F.col("h"))).collect()] == ["portrait", "square", "square", "landscape", None, None]
