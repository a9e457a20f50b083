import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.sources import files
from granary.streaming import frames as V
from tests.test_kernels import APPLE, png

COLOURS = {"Unripe": (30, 210, 20), "Ripe": (240, 210, 30), "Overripe": (80, 40, 20)}


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    for split, n in (("Train", 6), ("Test", 1)):
        for stage, c in COLOURS.items():
            (root / split / stage).mkdir(parents=True)
            for i in range(n):
                img = np.full((40, 40, 3), 255, np.uint8)
                img[8:32, 8:32] = c
                img[0, 0] = i + 10 * n
                (root / split / stage / f"apple_{stage.lower()}_{i}.png").write_bytes(png(img))
    return str(root)


def test_baseline_then_final_test(spark, data, tmp_path, capsys):
    assert cli.main(["baseline", "--data", data, "--out", str(tmp_path), "--method", "hsv", "--trees", "5", "--depth", "4"]) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    assert json.loads(open(folder + "/metadata.json").read())["status"] == "completed"
    with pytest.raises(PermissionError):
        cli.main(["final-test", "--data", data, "--run", folder, "--out", str(tmp_path)])
    cli.main(["final-test", "--data", data, "--run", folder, "--out", str(tmp_path), "--confirm-frozen", "--trusted-model"])
    done = capsys.readouterr().out.strip().splitlines()[-1]
    assert spark.read.parquet(done + "/predictions").count() == 3
    assert {(r.scope, r.accuracy) for r in spark.read.parquet(done + "/metrics").collect()} == {("overall", 1.0), ("apple", 1.0)}


def test_audit_and_report(spark, data, tmp_path):
    img = np.random.default_rng(4).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Train/Ripe/apple_ripe_1.png", png(img, 0))
        z.writestr("Test/Ripe/apple_ripe_2.png", png(img, 9))
        z.writestr("Train/Unripe/mango_unripe_1.jpg", "not an image")
        z.writestr("notes.txt", "x")
    folder = cli.audit(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert json.loads(open(folder + "/summary.json").read()) == {"valid_images": 2, "invalid_images": 1, "sha256_groups": 0, "pixel_sha256_groups": 1}
    assert spark.read.csv(folder + "/audit.csv", header=True).count() == 3
    report = spark.read.csv(cli.blemish(spark, data, str(tmp_path / "out"), "test", "hsv") + "/blemish_report.csv", header=True).collect()
    assert len(report) == 3 and {r.segmentation_method for r in report} == {"hsv"}


def test_scan_with_content(spark, data):
    rows = files.scan_images(spark, data, content=True).collect()
    assert len(rows) == 21 and all(bytes(r.content[:4]) == b"\x89PNG" and not r.path.startswith(("/", "file")) for r in rows)


@pytest.fixture
def video(tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i:04d}.png").write_bytes(png(APPLE) if i != 3 else b"broken")
    return folder


def test_video(spark, video, tmp_path):
    heard = []
    rows = V.process_video(spark, str(video), str(tmp_path / "done"), V.segment_frames("hsv"), fps=10, chunk=3, emit=lambda kind, what: heard.append((kind, what.get("done"))))
    got = {r.frame_index: r for r in rows.collect()}
    assert sorted(got) == list(range(1, 8)) and got[4].error and got[7].timestamp_seconds == pytest.approx(0.6) and got[1].foreground_pixels > 0
    assert heard == [("progress", 3), ("progress", 6), ("progress", 7), ("completed", None)]
    with pytest.raises(FileExistsError):
        V.process_video(spark, str(video), str(tmp_path / "done"), V.segment_frames("hsv"))


def test_cancelled_and_empty_videos_leave_nothing(spark, video, tmp_path):
    asked = []
    assert V.process_video(spark, str(video), str(tmp_path / "x"), V.segment_frames("hsv"), chunk=3, cancelled=lambda: bool(asked.append(1)) or len(asked) > 1) is None
    for p in video.iterdir():
        p.write_bytes(b"broken")
    with pytest.raises(ValueError, match="no decodable"):
        V.process_video(spark, str(video), str(tmp_path / "y"), V.segment_frames("hsv"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["frames"]


def test_camera(spark, video, tmp_path):
    live = V.live_frames(V.camera_frames(spark, str(video)), V.segment_frames("hsv"), 0.0)
    q = live.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.count() == 7 and rows.where("error <> ''").count() == 1


def test_a_source_that_stops(spark, tmp_path):
    def run(errors, name):
        df = spark.createDataFrame([("cam", i, e) for i, e in enumerate(errors)], "source string, n int, error string")
        df.write.parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / name / "in"))
        q = V.fail_after(stream, "source", "n").writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name / "out")).count()

    assert run(["x"] * 4 + [""] + ["x"] * 4, "goes_on") == 9
    with pytest.raises(Exception, match="stopped returning frames"):
        run(["", *["x"] * 5], "stops")
