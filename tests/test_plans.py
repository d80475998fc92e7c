"""Plans around a dataset: profiles, records, jobs in parts, presets, quality reports."""

import json
import time

import pytest

from strandline import cli
from strandline.media import mp4
from strandline.media.jobs import probe_files, video_digests
from strandline.operators import planning
from strandline.operators.align import asof_clamped
from strandline.operators.quality import fix_nan
from strandline.plans import datasets as D
from strandline.plans.doctor import gate, portability
from strandline.plans.planner import plan_and_convert, plan_conversion, profile
from strandline.plans.record import JobStore, StageRecorder, prepare, run_part, try_finalize
from strandline.sinks.layouts import episode_sizes
from strandline.sinks.publish import check_paths
from strandline.sources import files, presets
from strandline.sources.hdf5 import Hdf5Config, NumericField, VideoField
from strandline.sources.layouts import open_dataset
from strandline.sources.timestamped import CAMERA, TimestampedConfig, read_timestamped
from tests.fixtures import jpeg, make_dataset


def test_profile_and_planned_conversion(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a", cameras=("wrist",)))
    found = profile(spark, root)
    assert (found.episodes, found.frames, found.cameras, found.data_files, found.video_files) == (3, 13, 1, 3, 3)
    assert found.episodes_per_file["max"] == 1 and found.bytes_per_row == found.logical["total"] // 13
    stored = sum(p.stat().st_size for p in (tmp_path / "a/data").rglob("*.parquet"))
    assert found.stored["total"] == stored
    done = plan_and_convert(spark, root, str(tmp_path / "b"), "3.0")
    assert done["frames"] == 13 and done["plan"]["data_tasks"] == 1
    sizes = {r["episode_index"]: r["bytes"] for r in episode_sizes(open_dataset(spark, str(tmp_path / "b"))).collect()}
    whole = (tmp_path / "b/data/chunk-000/file-000.parquet").stat().st_size
    assert sizes == {0: round(whole * 5 / 13), 1: round(whole * 2 / 13), 2: round(whole * 6 / 13)}
    with pytest.raises(ValueError):
        plan_conversion(spark, root, "2.1", data_mb=5)
    with pytest.raises(ValueError):
        plan_conversion(spark, root, "3.0", data_mb=-1)


def test_recorder():
    told = StageRecorder()
    with pytest.raises(KeyError), told.measure("read", tasks=2, input_bytes=10):
        raise KeyError
    told.add("read", 1.5, tasks=1)
    assert told.snapshot()["read"]["tasks"] == 3 and told.snapshot()["read"]["seconds"] >= 1.5


def test_conversion_in_parts(spark, tmp_path):
    root, out = str(make_dataset(tmp_path / "a", cameras=("wrist",))), str(tmp_path / "out")
    store = prepare(spark, str(tmp_path / "job"), root, out, "3.0", [(0, 1), (1, 3)])
    assert not try_finalize(spark, store)
    run_part(spark, store, 1)
    assert store.status() == {"parts": 2, "running": 0, "done": 1, "failed": 0, "pending": 1, "finished": False}
    again = JobStore(spark, str(tmp_path / "job"))  # as another driver finds it
    run_part(spark, again, 0)
    with again.locked():
        assert not try_finalize(spark, store)  # someone else is at it
    assert try_finalize(spark, store) and try_finalize(spark, again)
    report = D.compare(open_dataset(spark, root), open_dataset(spark, out), check_videos=True)
    assert report.ok, report.errors
    with pytest.raises(FileExistsError):
        prepare(spark, str(tmp_path / "job"), root, out, "3.0", [])
    broken = prepare(spark, str(tmp_path / "job2"), str(tmp_path / "nothing"), out, "3.0", [(0, 1)])
    with pytest.raises(Exception):
        run_part(spark, broken, 0)
    assert broken.status()["failed"] == 1


def test_presets(monkeypatch, tmp_path):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    mapping = Hdf5Config((NumericField("obs/q", "state", "float32", 7),), (VideoField("obs/rgb", "cam"),), 20)
    made = presets.save(presets.Preset("lab.arm", mapping, "ours"))
    assert presets.load("lab.arm") == presets.load(made) == presets.listed()[0]
    with pytest.raises(FileExistsError):
        presets.save(presets.Preset("lab.arm", mapping))
    for bad in (Hdf5Config(), Hdf5Config((NumericField("a", "index"),)), Hdf5Config((NumericField("a", "x"), NumericField("b", "x"))), Hdf5Config((NumericField("a", "x"),), fps=0), Hdf5Config((NumericField("a", "x"),), (VideoField("b", "x"),))):
        with pytest.raises(ValueError):
            presets.save(presets.Preset("bad", bad))
    with pytest.raises(ValueError):
        presets.save(presets.Preset("../x", mapping))
    (tmp_path / "x.json").write_text("[]")
    with pytest.raises(ValueError):
        presets.load(tmp_path / "x.json")
    with pytest.raises(FileNotFoundError):
        presets.load("nothing")


def test_recordings_become_videos(spark, tmp_path):
    root = tmp_path / "rec/episode1"
    for c, name in enumerate(("one", "two")):
        (root / f"camera/color/{name}").mkdir(parents=True)
        for i in range(5 if c else 4):
            (root / f"camera/color/{name}/{1 + i / 4 + c / 100:.2f}.jpg").write_bytes(jpeg(10 * c + i))
    for role in ("puppetLeft", "puppetRight", "masterLeft", "masterRight"):
        (root / f"arm/jointState/{role}").mkdir(parents=True)
        (root / f"arm/jointState/{role}/1.00.json").write_text(json.dumps({"position": [0.0] * 7}))
    config = TimestampedConfig(cameras=("one", "two"), fps=4)
    data = read_timestamped(spark, str(tmp_path / "rec"), config)
    assert data.info.cameras == [CAMERA + "one", CAMERA + "two"]
    for version in ("2.1", "3.0"):
        D.convert(spark, data, str(tmp_path / version), version)
        made = open_dataset(spark, str(tmp_path / version))
        assert made.info.features[CAMERA + "two"].extra["info"]["video.codec"] == "jpeg"
        digests = {r["camera"]: r["digest"] for r in video_digests(made).collect()}
        from tests.fixtures import movie

        assert digests == {CAMERA + "one": mp4.packet_digest(movie([jpeg(i) for i in range(4)])), CAMERA + "two": mp4.packet_digest(movie([jpeg(10 + i) for i in range(1, 5)]))}
        assert not (tmp_path / version / ".muxed").exists()
        assert probe_files(spark, str(tmp_path / version)).count() == 2
    assert mp4.jpeg_passthrough([jpeg(1), jpeg(2)]) and not mp4.jpeg_passthrough([jpeg(1), jpeg(2, 8, 8)]) and not mp4.jpeg_passthrough([b"png"]) and not mp4.jpeg_passthrough([])


def test_gate_portability_and_deletion(spark, tmp_path):
    root = make_dataset(tmp_path / "a")
    data = open_dataset(spark, str(root))
    assert gate(data, "act").errors == ["there is no feature observation.state", "there is no feature action", "there is no camera", "no episode has 100 frames"]
    report = gate(data, "diffusion", chunk_size=4, state="gripper.pose", action="command")
    assert report.errors == ["there is no camera"] and report.warnings == ["1 of 3 episodes have fewer than 4 frames"]
    with pytest.raises(ValueError):
        gate(data, "none")
    assert portability(spark, str(root)).ok
    (root / "notes.txt").write_text("x")
    (root / "meta/link").symlink_to("/etc")
    told = portability(spark, str(root))
    assert len(told.errors) == 1 and "link" in told.errors[0] and any("notes.txt" in w for w in told.warnings)
    (root / "meta/link").unlink()
    D.edit_dataset(spark, str(root), str(tmp_path / "e"), D.EditConfig((1,)))
    edited = open_dataset(spark, str(tmp_path / "e"))
    assert D.check_deletion(data, edited, [1]).ok and not D.check_deletion(data, edited, [0]).ok
    assert D.merge_check(spark, [str(root), str(tmp_path / "e")]).ok
    assert D.merge_check(spark, [str(root), str(root) + "/"]).errors
    info = json.loads((root / "meta/info.json").read_text())
    (root / "meta/info.json").write_text(json.dumps(info | {"fps": 13, "splits": {"all": "0:3"}}))
    assert len(D.merge_check(spark, [str(root), str(tmp_path / "e")]).errors) == 2
    assert sorted(r["episode_index"] for r in data.episodes_of([0, 2]).select("episode_index").distinct().collect()) == [0, 2]
    assert D.without_videos(open_dataset(spark, str(make_dataset(tmp_path / "v", cameras=("wrist",))))).info.cameras == []


def test_paths_are_safe(spark, tmp_path, monkeypatch):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    for source, destination in (("a", "a/b/c"), ("a/b", "a"), ("a", "link/x"), ("link", "a/../a/y"), ("a", "a")):
        with pytest.raises(ValueError):
            check_paths(spark, str(tmp_path / destination), [str(tmp_path / source)])
    monkeypatch.chdir(tmp_path)
    check_paths(spark, str(tmp_path / "ab"), [str(tmp_path / "a")], need_bytes=1)
    with pytest.raises(ValueError):
        check_paths(spark, str(tmp_path / "ab"), [], need_bytes=1 << 60)
    assert files.create_new(spark, str(tmp_path / "f"), "x") and not files.create_new(spark, str(tmp_path / "f"), "y")


def test_planning_rules(spark):
    jobs = spark.createDataFrame([(i, s) for i, s in enumerate([5, 1, 9, 9, 2, 40])], "job int, size bigint")
    order = [r["job"] for r in planning.largest_first(jobs, cost="size", key="job").orderBy("turn").collect()]
    assert order == [5, 2, 3, 0, 4, 1]
    head = lambda **k: sorted(r["job"] for r in planning.head_within(jobs, size="size", key="job", **k).collect())
    assert head(budget=8) == [0, 1, 4] and head(budget=26, most=2) == [1, 4] and head(budget=1) == [1] and head(budget=0) == []
    runs = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 10.2), ("a", 4, 19.0), ("a", 8, 19.4), ("b", 1, 3.0)], "job string, workers int, rate double")
    assert {r["job"]: r["workers"] for r in planning.throughput_knee(runs, workers="workers", throughput="rate", by=["job"]).collect()} == {"a": 4, "b": 1}
    assert {r["job"]: r["workers"] for r in planning.least_near_peak(runs, workers="workers", throughput="rate", by=["job"]).collect()} == {"a": 4, "b": 1}
    batches = lambda steps, budget: sorted((r["step"], r["job"]) for r in planning.sample_batches(jobs, order="job", size="size", steps=steps, budget=budget).collect())
    assert batches([1, 2, 3], 100) == [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5)]
    assert batches([1, 2, 4], 100) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]  # too few jobs to be disjoint
    assert batches([1, 2, 3], 20) == [(0, 0), (1, 1), (1, 2)]
    mounts = spark.createDataFrame([("/", "root"), ("/data", "net"), ("/data/fast/", "disk"), ("/dat", "other")], "mount string, kind string")
    paths = spark.createDataFrame([("/data/fast/x/y",), ("/data/fastest",), ("/data",), ("/home/z",), ("/",)], "path string")
    got = {r["path"]: r["kind"] for r in planning.longest_prefix(paths, mounts, path="path", mount="mount").collect()}
    assert got == {"/data/fast/x/y": "disk", "/data/fastest": "net", "/data": "net", "/home/z": "root", "/": "root"}


def test_one_key_with_many_rows_is_linear(spark):
    """Times that a plan quadratic in a key's rows could not keep."""
    n = 300_000
    rows = spark.range(n).selectExpr("1 as k", "id as t", "if(id > 1000 and id % 7 = 0, cast(id as double), null) as v")
    began = time.perf_counter()
    got = asof_clamped(spark.range(n).selectExpr("1 as k", "id as t", "id as a"), rows.where("v is not null"), by=["k"], on="t", value="v", tie=[])
    assert got.selectExpr("sum(if(t < 1001, v = 1001, v = floor(t / 7) * 7) :: int) as s").first()["s"] == n
    fixed = fix_nan(rows, by=["k"], order=["t"], value="v")
    assert fixed.selectExpr("count(v) as c").first()["c"] == n
    assert time.perf_counter() - began < 60


def test_command_line_of_plans(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a"))
    run = lambda *a: cli.run(spark, cli._parser().parse_args(list(a)))
    assert run("plan", root, "--to", "3.0")[0]["plan"]["target_version"] == "v3.0"
    assert run("convert", root, str(tmp_path / "b"), "--to", "3.0", "--dry-run")[0]["written"] is False
    assert run("plan", root, "--to", "3.0", "--run", str(tmp_path / "b"))[0]["frames"] == 13
    assert run("compare", root, str(tmp_path / "b"), "--videos")[1]
    assert not run("gate", root, "--policy", "act")[1] and run("portability", root)[1]
    assert not run("merge-check", root, str(tmp_path / "b"))[1] and run("presets")[1]
