import pytest

from strandline.plans.doctor import Limits, doctor, duplicate_episodes, fixed, scores
from strandline.plans.sizing import environment_report, makespan, size_profile, target_for_balance, target_for_parallelism
from strandline.sources.layouts import open_dataset
from tests.fixtures import make_dataset


def test_doctor(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a", (12, 4, 15)))
    report = doctor(spark, root)
    assert report["ok"] and report["findings"] == {"short": 1} and report["episodes"] == 3 and report["ready"]
    data = open_dataset(spark, root)
    assert duplicate_episodes(data).count() == 0
    moved = data.frames.where("episode_index <> 2 or frame_index <> 6")
    rated = {r["episode_index"]: r for r in scores(data.with_(frames=moved), Limits(drop_score=0.75)).collect()}
    assert rated[2]["reasons"] == ["timing"] and rated[2]["keep"] and rated[1]["reasons"] == ["short"] and not rated[1]["keep"]
    again = fixed(data.with_(frames=moved))
    assert [r["index"] for r in again.frames.orderBy("index").collect()] == list(range(30))
    assert scores(again).where("array_contains(reasons, 'timing')").count() == 0


def test_duplicates(spark, tmp_path):
    data = open_dataset(spark, str(make_dataset(tmp_path / "a")))
    twin = data.frames.where("episode_index = 1").selectExpr("*").withColumn("episode_index", data.frames["episode_index"] + 9)
    assert [r[0] for r in duplicate_episodes(data.with_(frames=data.frames.unionByName(twin))).collect()] == [10]


def test_sizing(spark, tmp_path):
    assert makespan([5, 4, 3], 2) == 7
    assert target_for_balance([10] * 8, [11, 21, 81], 4, 21) == 21
    assert target_for_parallelism(100, 10, 50, 5) == 10 and target_for_parallelism(10, 10, 50, 5) == 5
    profile = size_profile(open_dataset(spark, str(make_dataset(tmp_path / "a"))))
    assert profile["count"] == 3 and profile["min"] <= profile["p50"] <= profile["max"]
    assert environment_report(spark)["pyspark"].startswith("4")
    with pytest.raises(ValueError):
        target_for_balance([1], [], 1, 1)
