from pyspark.sql import functions as F

from granary.functions import normalize as N
from granary.functions import scalars as S


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c")).alias("x")).collect()]


def test_paths(spark):
    rows = ["a/b.jpg", " ./a//b.jpg ", ".\\a\\b.jpg", "a/./b.jpg", "dataset/a/b.jpg", "A/b.jpg", "", "  ", None]
    assert values(spark, rows, "string", N.plain_path) == ["a/b.jpg"] * 4 + ["dataset/a/b.jpg", "A/b.jpg", None, None, None]


def test_digests(spark):
    h = "ab" * 32
    assert values(spark, [h, h.upper(), f" sha256:{h}\n", "0" * 64, "", "abc", None], "string", N.digest) == [h] * 3 + [None] * 4


def test_phash(spark):
    rows = ["00000000000000ff", "FF", "0Xff", " 0x00:00:00:00:00:00:00:ff ", "00ff", "ffff-ffff-ffff-ffff", "n/a", "-", "", "0000", "1" * 17, None]
    assert values(spark, rows, "string", N.phash_bits) == [255] * 5 + [-1] + [None] * 6


def test_names(spark):
    assert values(spark, ["Train ", "VAL", "validation", "\tTest", "", None], "string", N.split_name) == ["train", "validation", "validation", "test", None, None]
    assert values(spark, ["S-1", " s-1", "Unknown", "n/a", "", None], "string", N.specimen_name) == ["s-1", "s-1", None, None, None, None]


def test_labels(spark):
    rows = ["dataset/Train/Overipe/apple_overripe_001.jpg", "Train/Ripe/apple_unripe_001.jpg", "Test/Ripe/pear_ripe_1.jpg", "flat.jpg", "extra/Ripe/apple_ripe_1.jpg", "Val/Ripe/apple.jpg", None]
    got = values(spark, rows, "string", S.parse_labels)
    assert tuple(got[0]) == ("train", "apple", "overripe", "overipe", "")
    assert [r.error for r in got[1:6]] == ["file name does not match its folder", "unknown fruit or stage", "path has no split and stage folder", "unknown split", "file name does not match its folder"]
    assert got[6] is None


def test_safe_cells(spark):
    rows = ['=HYPERLINK("bad")', "  +1", "-5", "@x", "\t=1", "plain", "a=b", "", None]
    assert values(spark, rows, "string", S.safe_cell) == ["'" + x for x in rows[:5]] + ["plain", "a=b", "", None]


def test_grades(spark):
    assert values(spark, [0.0, 0.05, 0.051, 0.15, 0.151, None], "double", S.quality_grade) == ["Good", "Good", "Acceptable", "Acceptable", "Poor", "Not graded"]
    import pytest

    with pytest.raises(Exception, match="outside 0..1"):
        values(spark, [1.01], "double", S.quality_grade)


def test_run_labels(spark):
    rows = ["20260828T085810_496281Z", "other", "20261399T000000_000000Z", None]
    assert values(spark, rows, "string", S.run_label) == ["28 Aug 2026, 08:58:10 UTC", "other", "20261399T000000_000000Z", None]


def test_ties_and_sizes(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.8, 0.1), (None, 0.5, 0.5), (float("nan"), 0.1, 0.9)], "a double, b double, c double")
    assert [r[0] for r in df.select(S.first_max(["unripe", "ripe", "overripe"], [F.col("a"), F.col("b"), F.col("c")])).collect()] == ["unripe", "ripe", None, None]
    r = spark.range(1).select(S.letterbox(F.lit(100), F.lit(50)).alias("l"), S.working_size(F.lit(600), F.lit(400), 200).alias("w"), S.clamp_box(F.lit(-3.2), F.lit(1.5), F.lit(500.1), F.lit(-2.0), F.lit(300), F.lit(200)).alias("b")).first()
    assert tuple(r.l) == (224, 112, 0, 56) and tuple(r.w) == (200, 133) and tuple(r.b) == (0, 1, 300, 1)


def test_display(spark):
    df = spark.createDataFrame([(0.12345, 46.05, "a/b.jpg", ""), (None, None, None, None)], "accuracy double, x_ms double, source string, stage string")
    got = [tuple(r) for r in df.select(*[S.display(c, F.col(c)) for c in df.columns]).collect()]
    assert got == [("12.35%" if f"{0.12345:.2%}" == "12.35%" else "12.34%", f"{46.05:.1f} ms", "b.jpg", "-"), ("-",) * 4]
