import io
import json
import random
import struct
from functools import partial
from types import SimpleNamespace

import pytest

from strandline import dataset_queries
from strandline.media import jobs, mp4
from strandline.media.jobs import planned, video_digests, video_faults
from strandline.model import Info
from strandline.plans import datasets as D
from strandline.sources import stores
from strandline.sources.layouts import open_dataset
from tests.fixtures import FPS, LENGTHS, jpeg, make_dataset, movie


def test_mux_and_probe():
    pictures = [jpeg(3 * i) for i in range(9)]
    file = movie(pictures, 18)
    assert mp4.probe(file) == {"codec": "jpeg", "width": 40, "height": 16, "frames": 9, "fps": 18.0, "duration": 0.5, "audio": False}
    assert [d for d, _ in mp4.packets(file, mp4.read_track(file))] == pictures
    streamed = io.BytesIO()
    mp4.mux_jpegs(iter(pictures), 18, streamed, sizes=[len(p) for p in pictures])
    assert streamed.getvalue() == file.getvalue()
    with pytest.raises(ValueError):
        movie([])
    with pytest.raises(ValueError):
        movie([jpeg(1), jpeg(2, width=64)])
    with pytest.raises(ValueError):
        mp4.mux_jpegs(iter(pictures), 18, io.BytesIO(), sizes=[1] * 9)


def test_joined_and_cut_files_keep_their_packets():
    parts = [movie([jpeg(100 * k + i) for i in range(n)]) for k, n in enumerate((6, 1, 12))]
    whole = io.BytesIO()
    mp4.concatenate(parts, whole)
    edges = [0.0, 0.5, 7 / 12, 19 / 12]
    assert [mp4.packet_digest(whole, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] == [mp4.packet_digest(p) for p in parts]
    outs = [io.BytesIO() for _ in parts]
    mp4.split(whole, list(zip(edges[:-1], edges[1:], outs, strict=True)))
    assert [mp4.packet_digest(o) for o in outs] == [mp4.packet_digest(p) for p in parts]
    with pytest.raises(ValueError):
        mp4.concatenate([parts[0], movie([jpeg(1)], fps=20)], io.BytesIO())
    with pytest.raises(ValueError):
        mp4.read_track(io.BytesIO(b"\0\0\0\x08free"))


def h264(kinds):
    """A file whose packets hold one unit each: 5 refreshes, 1 follows."""
    units = [struct.pack(">I", 3) + bytes([k, 7, i]) for i, k in enumerate(kinds)]
    entry = mp4._box(b"avc1", b"\0" * 24 + struct.pack(">HH", 64, 48) + b"\0" * 50, mp4._box(b"avcC", b"\x01\x42\x00\x1e\xff\xe0\x00"))
    like = mp4.Track(10, "avc1", 64, 48, b"\0\0\0\0\0\0\0\x01" + entry)
    out = io.BytesIO()
    mp4.write_mp4(out, like, [mp4.Sample(0, len(u), 0, 0, 1, k == 5) for u, k in zip(units, kinds, strict=True)], units)
    return out


def test_cuts_are_proven_safe():
    file = h264([5, 1, 1, 5, 1, 5])
    assert mp4.read_track(file).codec == "avc1"
    assert mp4.remux_safe(file, [(0.0, 0.3), (0.3, 0.5), (0.5, 0.6)])
    assert not mp4.remux_safe(file, [(0.1, 0.3)]) and not mp4.remux_safe(file, [(2.0, 3.0)])
    assert mp4.remux_safe(movie([jpeg(i) for i in range(4)]), [(1 / FPS, 3 / FPS)])
    with pytest.raises(ValueError):
        mp4.split(file, [(0.1, 0.3, io.BytesIO())])


CAMERAS = ("wrist", "side.cam")


def digests(spark, root):
    return {(r["episode_index"], r["camera"]): r["digest"] for r in video_digests(open_dataset(spark, str(root))).collect()}


def expected(episodes, cameras=CAMERAS, lengths=LENGTHS, picture=0):
    """Digest of each (episode, camera) of a fixture, in the given order of episodes."""
    return {(new, k): mp4.packet_digest(movie([jpeg(picture + 1000 * CAMERAS.index(k) + 100 * old + i) for i in range(lengths[old])])) for new, old in enumerate(episodes) for k in cameras}


def test_conversion_carries_media(spark, tmp_path):
    make_dataset(tmp_path / "a", cameras=CAMERAS)
    D.convert(spark, str(tmp_path / "a"), str(tmp_path / "b"), "3.0")
    D.convert(spark, str(tmp_path / "b"), str(tmp_path / "c"), "2.1")
    assert digests(spark, tmp_path / "a") == digests(spark, tmp_path / "b") == digests(spark, tmp_path / "c") == expected([0, 1, 2])
    assert len(list((tmp_path / "b/videos/wrist").rglob("*.mp4"))) == 1  # packed
    small = D.convert(spark, str(tmp_path / "a"), str(tmp_path / "d"), "3.0", video_mb=0.0001, dry_run=True)
    assert small["written"] is False and not (tmp_path / "d").exists()
    D.convert(spark, str(tmp_path / "a"), str(tmp_path / "d"), "3.0", video_mb=0.0005)
    assert len(list((tmp_path / "d/videos/wrist").rglob("*.mp4"))) > 1
    a, d = open_dataset(spark, str(tmp_path / "a")), open_dataset(spark, str(tmp_path / "d"))
    report = D.compare(a, d, check_videos=True)
    assert report.ok, report.errors
    assert not [p for p in (tmp_path / "b").rglob(".*") if not p.name.endswith(".crc")]


@pytest.mark.parametrize("version", ["2.1", "3.0"])
def test_videos_follow_their_episodes(spark, tmp_path, version):
    make_dataset(tmp_path / "a", cameras=CAMERAS)
    make_dataset(tmp_path / "b", (3, 4), task="other", base=50.0, cameras=CAMERAS, picture=5000)
    roots = [tmp_path / "a", tmp_path / "b"]
    if version == "3.0":
        for k in "ab":
            D.convert(spark, str(tmp_path / k), str(tmp_path / f"{k}3"), "3.0")
        roots = [tmp_path / "a3", tmp_path / "b3"]
    D.edit_dataset(spark, str(roots[0]), str(tmp_path / "edit"), D.EditConfig((0,)))
    assert digests(spark, tmp_path / "edit") == expected([1, 2])
    D.edit_dataset(spark, str(roots[0]), str(tmp_path / "middle"), D.EditConfig((1,), ("side.cam",)))
    assert digests(spark, tmp_path / "middle") == expected([0, 2], ("wrist",))
    assert not (tmp_path / "middle/videos/side.cam").exists()
    D.convert(spark, D.subset(open_dataset(spark, str(roots[0])), 1, 3), str(tmp_path / "part"), version)
    assert digests(spark, tmp_path / "part") == expected([1, 2])
    D.merge_datasets(spark, list(map(str, roots)), str(tmp_path / "merged"))
    second = expected([0, 1], lengths=(3, 4), picture=5000)
    assert digests(spark, tmp_path / "merged") == expected([0, 1, 2]) | {(e + 3, k): v for (e, k), v in second.items()}
    assert D.validate(spark, str(tmp_path / "merged"), deep=True).ok
    if version == "3.0":  # files that lose nothing are reused
        modes = {r["mode"] for r in planned(open_dataset(spark, str(tmp_path / "merged")), "v3.0").collect()}
        assert modes == {"reuse"}


def test_video_faults(spark, tmp_path):
    root = make_dataset(tmp_path / "a", cameras=("wrist",))
    assert video_faults(open_dataset(spark, str(root)), deep=True).count() == 0
    (root / "videos/chunk-000/wrist/episode_000002.mp4").unlink()
    (root / "videos/chunk-000/wrist/episode_000000.mp4").write_bytes(movie([jpeg(1)]).getvalue())
    found = {(r["episode_index"], r["code"]) for r in video_faults(open_dataset(spark, str(root)), deep=True).collect()}
    assert found == {(2, "missing_video"), (0, "short_video")}
    assert any("missing video" in e for e in D.validate(spark, str(root)).errors)
    other = make_dataset(tmp_path / "b", cameras=("wrist",), picture=7)
    (other / "videos/chunk-000/wrist/episode_000001.mp4").write_bytes(movie([jpeg(900), jpeg(901)]).getvalue())
    make_dataset(tmp_path / "c", cameras=("wrist",), picture=7)
    report = D.compare(open_dataset(spark, str(other)), open_dataset(spark, str(tmp_path / "c")), check_videos=True)
    assert report.errors == ["episode 1, wrist: video differs"]


def test_bad_h264_metadata_is_an_error(tmp_path):
    assert json.dumps(mp4.probe(h264([5, 1])))
    assert mp4._nal_types(b"\0\0\0\x09\x05", 4) == set()


def test_a_packed_file_of_many_sources_holds_few_open(tmp_path, monkeypatch):
    films = []
    for i in range(40):
        path = tmp_path / f"{i}.mp4"
        path.write_bytes(movie([jpeg(2 * i), jpeg(2 * i + 1)]).getvalue())
        films.append(SimpleNamespace(target="whole.mp4", path=str(path), start=0.0, stop=2 / FPS, mode="remux", packets=2, bytes=len(jpeg(2 * i)) + len(jpeg(2 * i + 1))))
    held, most, reader = [], [0], stores.reader

    def watched(path):
        held.append(reader(path))
        most[0] = max(most[0], sum(not f.closed for f in held))
        return held[-1]

    monkeypatch.setattr(stores, "reader", watched)
    assert jobs._write(films, str(tmp_path), 0)[::2] == ("whole.mp4", 80)
    assert most[0] <= 2 and all(f.closed for f in held)
    with open(tmp_path / "whole.mp4", "rb") as file:
        assert mp4.packet_digest(file) == mp4.packet_digest(movie([jpeg(i) for i in range(80)]))
    films[3].bytes += 1
    with pytest.raises(ValueError):
        jobs._write(films, str(tmp_path / "again"), 0)


def test_slices_are_found_in_order_whatever_the_presentation():
    rng = random.Random(3)
    for shuffled in (False, True):
        samples = [mp4.Sample(i, 1, i, rng.randrange(4) if shuffled else 0, 1, True) for i in range(200)]
        track, first = mp4.Track(10, "avc1", 8, 8, b"", samples), min(s.dts + s.cts for s in samples)
        for _ in range(50):
            a, b = sorted(rng.randrange(220) / 10 for _ in range(2))
            assert mp4.within(track, a, b) == [s for s in samples if a - mp4.EPSILON <= (s.dts + s.cts - first) / 10 < b - mp4.EPSILON]
    assert mp4.within(mp4.Track(10, "avc1", 8, 8, b""), 0.0, 1.0) == []


def test_a_cut_in_a_large_file_does_not_read_its_whole_table():
    samples = [mp4.Sample(i, 1, i, 0, 1, True) for i in range(1000)]
    track = mp4.Track(10, "jpeg", 8, 8, b"", samples)
    mp4.within(track, 0.0, 0.1)

    class Counted(list):
        def __iter__(self):
            raise AssertionError("every sample is visited for each slice")

    track.samples = Counted(samples)
    assert mp4.within(track, 50.0, 50.2) == samples[500:502]


def test_times_in_a_packed_file_do_not_drift(spark, tmp_path):
    data = open_dataset(spark, str(make_dataset(tmp_path / "a", (1,) * 12, cameras=("wrist",))))
    rows = planned(data, "v3.0").orderBy("episode_index").collect()
    assert [(r["from_timestamp"], r["to_timestamp"]) for r in rows] == [(e / FPS, (e + 1) / FPS) for e in range(12)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_videos_of_every_chunk_are_taken_away(spark, monkeypatch, folder):
    monkeypatch.setattr(dataset_queries, "Info", partial(Info, chunks_size=6))
    wanted = spark.read.parquet(f"{folder}/conversations.parquet").where("conv_id % 5 = 1").select("conv_id").distinct().count()
    assert [tuple(r) for r in dataset_queries.video_faults(spark, folder).collect()] == [("missing_video", wanted)]
