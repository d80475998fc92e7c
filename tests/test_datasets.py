import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.operators.edit import episode_selection
from strandline.plans import datasets as D
from strandline.sinks import layouts
from strandline.sources.layouts import open_dataset
from tests.fixtures import make_dataset

STARTS, TOTAL = [0, 5, 7], 13


def test_both_layouts_say_the_same(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a"))
    assert D.validate(spark, root, deep=True).ok
    D.convert(spark, root, str(tmp_path / "b"), "3.0")
    D.convert(spark, str(tmp_path / "b"), str(tmp_path / "c"), "v2.1")
    a, b, c = (open_dataset(spark, str(tmp_path / x)) for x in "abc")
    assert b.info.version == "v3.0"
    for other in (b, c):
        report = D.compare(a, other)
        assert report.ok, report.errors
    shard = pq.read_table(tmp_path / "b/data/chunk-000/file-000.parquet")
    assert shard["index"].to_pylist() == list(range(TOTAL))
    assert {str(shard.schema.field(k).type) for k in ("timestamp", "force")} == {"float"}  # as declared, though one file has doubles
    merged = json.loads((tmp_path / "b/meta/stats.json").read_text())
    assert merged["index"]["mean"] == [pytest.approx((TOTAL - 1) / 2)] and merged["index"]["count"] == [TOTAL]
    assert merged["gripper.pose"]["max"][0] == max(7.0 * e for e in range(3))
    wide = pq.read_table(tmp_path / "b/meta/episodes/chunk-000/file-000.parquet")
    assert wide["dataset_from_index"].to_pylist() == STARTS and wide["dataset_to_index"].to_pylist() == [5, 7, 13]
    assert len(wide["stats/gripper.pose/mean"][1].as_py()) == 3


def test_quantiles_become_an_envelope(spark, tmp_path):
    root = make_dataset(tmp_path / "a")
    lines = [json.loads(x) for x in (root / "meta/episodes_stats.jsonl").read_text().splitlines()]
    for x in lines:
        e = x["episode_index"]
        x["stats"]["force"] |= {"q10": [1.0 + e], "q50": [5.0 - e], "q90": [9.0 + e]} | ({"q99": [9.5]} if e else {})
    (root / "meta/episodes_stats.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    D.convert(spark, str(root), str(tmp_path / "b"), "3.0")
    force = json.loads((tmp_path / "b/meta/stats.json").read_text())["force"]
    assert (force["q10"], force["q50"], force["q90"]) == ([1.0], [3.0], [11.0]) and "q99" not in force
    back = open_dataset(spark, str(tmp_path / "b")).episodes.where("episode_index = 1").first()["stats_json"]
    assert json.loads(back)["force"]["q99"] == [9.5]
    (root / "meta/episodes_stats.jsonl").write_text(json.dumps(lines[0]) + "\n")
    assert D.validate(spark, str(root)).errors == ["2 of 3 episodes have no statistics"]


def test_small_shards(spark, tmp_path):
    D.convert(spark, str(make_dataset(tmp_path / "a")), str(tmp_path / "b"), "3.0", data_mb=0.000001)
    assert len(list((tmp_path / "b/data/chunk-000").glob("*.parquet"))) == 3
    assert D.compare(open_dataset(spark, str(tmp_path / "a")), open_dataset(spark, str(tmp_path / "b"))).ok


def test_failed_conversion_leaves_nothing(spark, tmp_path):
    root = make_dataset(tmp_path / "a")
    (root / "data/chunk-000/episode_000001.parquet").unlink()
    with pytest.raises(Exception):
        D.convert(spark, str(root), str(tmp_path / "b"), "3.0", deep=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a"]
    with pytest.raises(ValueError):
        D.convert(spark, str(root), str(root / "inside"), "3.0")


def test_merge(spark, tmp_path):
    one, two = make_dataset(tmp_path / "a"), make_dataset(tmp_path / "b", (1, 8), task="fold the towel", base=40.0)
    D.merge_datasets(spark, [str(one), str(two)], str(tmp_path / "m"))
    m = open_dataset(spark, str(tmp_path / "m"))
    assert [r["task"] for r in m.tasks.orderBy("task_index").collect()] == ["stack the cups", "fold the towel"]
    frames = m.frames.orderBy("index").collect()
    assert [r["index"] for r in frames] == list(range(TOTAL + 9))
    assert [r["task_index"] for r in frames] == [0] * TOTAL + [1] * 9
    stats = {r["episode_index"]: json.loads(r["stats_json"]) for r in m.episodes.collect()}
    assert stats[4]["index"]["mean"] == [TOTAL + 1 + 3.5] and stats[4]["task_index"]["max"] == [1]
    with pytest.raises(ValueError):
        D.merge_datasets(spark, [str(one)], str(tmp_path / "n"))


def test_edit(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a", splits={"train": "0:2", "held": "2:3"}))
    D.edit_dataset(spark, root, str(tmp_path / "e"), D.EditConfig((1,), ("command",), {2: "fold the towel"}))
    e = open_dataset(spark, str(tmp_path / "e"))
    assert e.info.splits == {"train": "0:1", "held": "1:2"}
    assert "command" not in e.frames.columns and "command" not in e.info.features
    assert [(r["task_index"], r["task"]) for r in e.tasks.orderBy("task_index").collect()] == [(0, "stack the cups"), (1, "fold the towel")]
    frames = e.frames.orderBy("index").collect()
    assert [r["index"] for r in frames] == list(range(11)) and [r["task_index"] for r in frames] == [0] * 5 + [1] * 6
    stats = json.loads(next(r["stats_json"] for r in e.episodes.collect() if r["episode_index"] == 1))
    assert stats["index"]["mean"] == [7.5]
    with pytest.raises(ValueError):
        D.edit_dataset(spark, root, str(tmp_path / "f"), D.EditConfig((0, 1, 2)))
    with pytest.raises(ValueError):
        D.edit_dataset(spark, root, str(tmp_path / "f"), D.EditConfig((), ("index",)))
    assert not (tmp_path / "f").exists()


def test_validation_finds_errors(spark, tmp_path):
    root = make_dataset(tmp_path / "a")
    info = json.loads((root / "meta/info.json").read_text())
    assert D.validate(spark, str(root)).warnings == ["command: shape [1, 2] has 2 dimensions, the column nests 1"]
    (root / "meta/info.json").write_text(json.dumps(info | {"total_frames": 10}))
    assert any("total_frames" in e for e in D.validate(spark, str(root)).errors)
    (root / "meta/info.json").write_text(json.dumps(info))
    file = root / "data/chunk-000/episode_000001.parquet"
    table = pq.read_table(file)
    pq.write_table(table.slice(0, 1), file)
    assert any("has 1 rows, 2 are expected" in e for e in D.validate(spark, str(root)).errors)
    first, last = (root / f"data/chunk-000/episode_{k:06d}.parquet" for k in (0, 2))
    pq.write_table(table, file)
    assert D.validate(spark, str(root), deep=True).ok
    whole = pq.read_table(first)
    pq.write_table(whole.set_column(whole.schema.get_field_index("frame_index"), "frame_index", pq.read_table(first)["index"].cast("int64").slice(0, 5).take([0, 1, 2, 3, 3])), first)
    assert any(e.startswith("frame_index in episode 0") for e in D.validate(spark, str(root), deep=True).errors)
    last.unlink()
    assert D.validate(spark, str(root)).errors == ["missing file data/chunk-000/episode_000002.parquet"]


def test_validation_of_packed_files(spark, tmp_path):
    D.convert(spark, str(make_dataset(tmp_path / "a")), str(tmp_path / "b"), "3.0", data_mb=0.000001)
    (tmp_path / "b/data/chunk-000/file-001.parquet").unlink()
    assert D.validate(spark, str(tmp_path / "b")).errors == ["missing file data/chunk-000/file-001.parquet"]


def test_subset(spark, tmp_path):
    data = open_dataset(spark, str(make_dataset(tmp_path / "a")))
    part = D.subset(data, 1, 3)
    assert [(r["episode_index"], r["index"]) for r in part.frames.orderBy("index").collect()] == [(0, 0), (0, 1)] + [(1, k) for k in range(2, 8)]
    assert [r["dataset_from_index"] for r in part.episodes.orderBy("episode_index").collect()] == [0, 2]


def test_episode_selection():
    assert episode_selection("1,4,10:13") == [1, 4, 10, 11, 12]
    for bad in ("", "a", "3:3", "5:2", "0:10000001", "-1"):
        with pytest.raises(ValueError):
            episode_selection(bad)


def test_metadata_of_many_episodes_does_not_pass_the_driver(spark, tmp_path, monkeypatch):
    first, second = str(make_dataset(tmp_path / "a", (1, 2) * 6)), str(tmp_path / "c")
    D.convert(spark, first, str(tmp_path / "b"), "3.0")

    def refused(*_, **__):
        raise AssertionError("rows are sent to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", refused)
    D.convert(spark, str(tmp_path / "b"), second, "2.1")
    for name in ("tasks", "episodes", "episodes_stats"):
        key = "task_index" if name == "tasks" else "episode_index"
        lines = [[json.loads(x)[key] for x in (tmp_path / folder / f"meta/{name}.jsonl").read_text().splitlines()] for folder in "ac"]
        assert lines[0] == lines[1] == sorted(lines[0])


def test_metadata_alone_lists_no_data_files(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a"))
    D.convert(spark, root, str(tmp_path / "b"), "3.0")
    for at in (root, str(tmp_path / "b")):
        whole, light = open_dataset(spark, at), open_dataset(spark, at, frames=False)
        assert light.frames.schema == whole.frames.schema and light.episodes.count() == whole.episodes.count() == 3
        assert whole.frames.count() == TOTAL and len(whole.frames.inputFiles()) > 0 and light.frames.count() == len(light.frames.inputFiles()) == 0


def test_an_edit_of_many_episodes_is_no_list_of_literals(spark, tmp_path, monkeypatch):
    root = str(make_dataset(tmp_path / "a", (1,) * 9))
    D.convert(spark, root, str(tmp_path / "b"), "3.0")

    def refused(*_, **__):
        raise AssertionError("work for what is not there, or a literal for each episode")

    monkeypatch.setattr(type(F.lit(1)), "isin", refused)
    monkeypatch.setattr(layouts, "quantile_envelope", refused)  # the fixture's statistics have no quantiles
    made = D.edit_dataset(spark, str(tmp_path / "b"), str(tmp_path / "e"), D.EditConfig((0, 3, 4, 8)))
    assert (made["episodes"], made["deleted"]) == (5, 4)
    assert [r[0] for r in open_dataset(spark, str(tmp_path / "e")).episodes.orderBy("episode_index").select("length").collect()] == [1] * 5
    with pytest.raises(ValueError, match=r"unknown episodes: \[9, 77\]"):
        D.edit_dataset(spark, root, str(tmp_path / "f"), D.EditConfig((1, 77, 9)))
