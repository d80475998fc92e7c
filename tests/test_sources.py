import dataclasses
import json

import pytest

from strandline import cli
from strandline.model import normalize_version
from strandline.schema import nested_shape, repaired_shape
from strandline.sources import Registry, SourceProvider, default_registry
from strandline.sources.files import natural_sort_key
from strandline.sources.timestamped import TimestampedConfig, read_timestamped
from tests.fixtures import make_dataset


@dataclasses.dataclass(frozen=True)
class TokenConfig:
    token: str = ""


class TokenProvider(SourceProvider):
    name = "token"
    aliases = ("tok",)
    config_type = TokenConfig

    def open(self, spark, root, config=None):
        return (root, config)


def test_registry(monkeypatch, tmp_path):
    registry = default_registry()
    assert registry.choices() == ["agilex", "auto", "hdf5", "lerobot"]
    file = tmp_path / "sources.toml"
    file.write_text('sources = ["tests.test_sources:TokenProvider"]')
    registry.discover(file)
    registry.discover(file)
    assert registry.info("tok").origin == str(file)
    spec = json.loads(json.dumps(registry.get("token").spec("/r", TokenConfig("x"))))
    assert registry.open_spec(None, spec) == ("/r", TokenConfig("x"))
    with pytest.raises(ValueError):
        registry.register(TokenProvider())
    with pytest.raises(KeyError):
        registry.get("nothing")
    with pytest.raises(ValueError):
        registry.get("token").config_from_dict({"other": 1})
    with pytest.raises(TypeError):
        Registry().register_module("json:dumps")


def test_small_rules():
    assert [normalize_version(v) for v in ("2.1", "21", "v2.1", "3", "30", "lerobot-v3.0")] == ["v2.1"] * 3 + ["v3.0"] * 3
    with pytest.raises(ValueError):
        normalize_version("4")
    assert repaired_shape((1, 2), (2,)) == (2,)
    with pytest.raises(ValueError):
        repaired_shape((3, 2), (2,))
    assert nested_shape([[1, 2], [3, 4]]) == (2, 2)
    for bad in ([], [[1], [1, 2]]):
        with pytest.raises(ValueError):
            nested_shape(bad)
    assert sorted(["e10", "E2", "e1"], key=natural_sort_key) == ["e1", "E2", "e10"]


def test_timestamped_alignment(spark, tmp_path):
    """A slow clock, a camera that starts before it, ties, and joints that begin after the first pictures."""
    root = tmp_path / "episode1"
    cameras = {"top": [2.0, 2.2, 2.4, 2.6, 2.8, 3.0], "belt": [1.9, 2.4, 2.9, 3.4], "rim": [2.05, 2.15, 2.45, 2.55, 2.95]}
    for name, times in cameras.items():
        (root / f"camera/color/{name}").mkdir(parents=True)
        for t in times:
            (root / f"camera/color/{name}/{t:.2f}.jpg").write_bytes(f"{name} {t}".encode())
    clock = [2.1, 2.2, 2.6, 2.75, 3.1]
    roles = ("puppetLeft", "puppetRight", "masterLeft", "masterRight")
    value = lambda k, t, j: round(1000 * t) + 10_000 * k + j * j
    for k, role in enumerate(roles):
        (root / f"arm/jointState/{role}").mkdir(parents=True)
        for t in clock:
            (root / f"arm/jointState/{role}/{t:.2f}.json").write_text(json.dumps({"position": [float(value(k, t, j)) for j in range(7)]}))
    config = TimestampedConfig(cameras=("top", "belt", "rim"), fps=5)
    data = read_timestamped(spark, str(tmp_path), config)
    rows = data.frames.orderBy("frame_index").collect()
    assert [r["index"] for r in rows] == [0, 1, 2, 3]
    # the clock shows 2.4, 2.6, 2.8 and 3.0: the four newest pictures that every camera has
    for r, t in zip(rows, (2.2, 2.6, 2.75, 2.75), strict=True):
        assert r["observation.state"] == [float(value(k, t, j)) for k in (0, 1) for j in range(7)]
        assert r["action"] == [float(value(k, t, j)) for k in (2, 3) for j in range(7)]
    stats = json.loads(data.episodes.collect()[0]["stats_json"])
    assert stats["index"]["mean"] == [1.5] and len(stats["observation.state"]["min"]) == 14
    (root / "arm/jointState/masterLeft/3.50.json").write_text('{"position": [1]}')
    with pytest.raises(ValueError):
        read_timestamped(spark, str(tmp_path), config)


def test_command_line(spark, tmp_path):
    root = str(make_dataset(tmp_path / "a"))
    run = lambda *a: cli.run(spark, cli._parser().parse_args(list(a)))
    assert run("validate", root, "--deep")[1]
    assert run("convert", root, str(tmp_path / "b"), "--to", "3.0")[0]["frames"] == 13
    assert run("compare", root, str(tmp_path / "b")) == ({"ok": True, "errors": [], "warnings": []}, True)
    assert run("edit", root, str(tmp_path / "c"), "--delete", "0:2")[0]["episodes"] == 1
    assert not run("compare", root, str(tmp_path / "c"))[1]
    assert len(run("inspect", root, "--limit", "2")[0]["episodes"]) == 2


def test_stream_of_episodes(spark, tmp_path):
    from strandline.operators.stats import merge_moments
    from strandline.streaming.append import append_statistics, arriving_frames

    make_dataset(tmp_path / "a")
    schema = "frame_index bigint, episode_index bigint"
    for _ in range(2):  # the second run finds nothing new
        frames = arriving_frames(spark, str(tmp_path / "a/data"), schema, files_per_trigger=1)
        append_statistics(frames, "frame_index", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    merged = merge_moments(spark.read.parquet(str(tmp_path / "out")), ["episode_index"]).orderBy("episode_index").collect()
    assert [(r["count"], r["mean"]) for r in merged] == [(5, 2.0), (2, 0.5), (6, 2.5)]
