"""Queries that write whole datasets and read them back, with the SQL that gives the same rows from the tables.

Conversations are episodes with a camera whose packets are the texts' bytes;
the classes of ``embeddings`` are episodes with a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .media import jobs, mp4
from .model import Dataset, Info, parse_split, video_slice
from .operators import planning, quality
from .plans import datasets as D
from .plans.planner import data_resources
from .queries import _rounded, _t, query
from .schema import SYSTEM_FEATURES, Feature
from .scratch import new_folder
from .sources import files, stores
from .sources.footers import data_profile
from .sources.layouts import open_dataset

FPS = 10
_SYSTEM = {k: Feature(d) for k, d in SYSTEM_FEATURES.items()}


def talks(spark: SparkSession, d: str) -> Dataset:
    """Conversations as a dataset without videos."""
    rows = _t(spark, d, "conversations")
    frames = rows.select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("frame_index"), F.col("role").alias("task"), F.array(F.octet_length("text").cast("float"), F.col("turn").cast("float")).alias("size.and turn"))
    n = rows.select("conv_id").distinct().count()
    return D.from_frames(frames, Info("v2.1", FPS, {"size.and turn": Feature("float32", (2,))} | _SYSTEM, "talk", {"train": f"0:{n}"}))


def filmed(spark: SparkSession, d: str) -> Dataset:
    """The same with a camera: each turn's text is a packet of a file of its conversation."""
    base = files.qualified(spark, new_folder(spark, "films"))

    def film(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, held = TaskContext.get().taskAttemptId(), []

        def made() -> tuple[int, str, float]:
            packets = [t.encode() for t in (r.text for r in held)]
            path = f"{base}/{held[0].conv_id:06d}.mp4"
            like = mp4.Track(FPS, "jpeg", 8, 8, b"\0\0\0\0\0\0\0\1" + mp4._box(b"jpeg", b"\0" * 78))
            stores.write(path, attempt, lambda out: mp4.write_mp4(out, like, [mp4.Sample(0, len(p), 0, 0, 1, True) for p in packets], packets))
            return held[0].conv_id, path, len(packets) / FPS

        for batch in batches:
            done = []
            for row in batch.itertuples():
                if held and held[0].conv_id != row.conv_id:
                    done.append(made())
                    held = []
                held.append(row)
            yield pd.DataFrame(done, columns=["episode_index", "path", "seconds"])
        if held:
            yield pd.DataFrame([made()], columns=["episode_index", "path", "seconds"])

    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    films = rows.repartition(2 * spark.sparkContext.defaultParallelism, "conv_id").sortWithinPartitions("conv_id", "turn").mapInPandas(film, "episode_index bigint, path string, seconds double").persist()
    data = talks(spark, d)
    listed = films.select("episode_index", F.to_json(F.array(video_slice("screen", F.col("path"), F.lit(0.0), F.col("seconds")))).alias("videos_json"))
    features = data.info.features | {"screen": Feature("video", (8, 8, 3))}
    info = Info("v2.1", FPS, features, "talk", data.info.splits)
    return data.with_(info=info, episodes=data.episodes.drop("videos_json").join(listed, "episode_index", "left"))


def classes(spark: SparkSession, d: str, condition: str = "true") -> Dataset:
    """The classes of the embeddings that a condition holds for, numbered from 0, as a dataset."""
    rows = _t(spark, d, "embeddings").where(condition)
    known = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # ten classes
    number = F.create_map(*(x for i, k in enumerate(known) for x in (F.lit(k), F.lit(i)))) if known else None
    order = Window.partitionBy("label").orderBy("vec_id")
    frames = rows.select(number[F.col("label")].cast("bigint").alias("episode_index"), (F.row_number().over(order) - 1).cast("bigint").alias("frame_index"), F.format_string("class %d", F.col("label")).alias("task"), "embedding")
    return D.from_frames(frames, Info("v2.1", FPS, {"embedding": Feature("float32", (64,))} | _SYSTEM, "vectors", {"train": f"0:{len(known)}"}))


def _written(spark: SparkSession, data: Dataset, version: str, **sizes: float) -> str:
    root = new_folder(spark, "dataset")
    D.convert(spark, data, root, version, **sizes)
    return root


def _vectors(data: Dataset) -> DataFrame:
    return data.frames.select("episode_index", "frame_index", "index", "task_index", F.col("embedding")[0].cast("double").alias("head"), F.col("embedding")[63].cast("double").alias("tail"))


_CLASSES = """r as (select label, vec_id, cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame_index, cast(embedding[1] as double) as head, cast(embedding[64] as double) as tail from embeddings),
c as (select label, dense_rank() over (order by label) - 1 as episode, n, sum(n) over (order by label) - n as start from (select label, count(*) as n from embeddings group by label))"""
_FRAMES = f"""with {_CLASSES} select cast(c.episode as bigint) as episode_index, frame_index, cast(c.start + frame_index as bigint) as "index", cast(c.episode as bigint) as task_index, head, tail from r join c using (label)"""


@query(_FRAMES)
def layout_v21(spark: SparkSession, d: str) -> DataFrame:
    """Written with a file for each episode, and read."""
    return _vectors(open_dataset(spark, _written(spark, classes(spark, d), "2.1")))


@query(_FRAMES)
def layout_v30_chain(spark: SparkSession, d: str) -> DataFrame:
    """Packed into small shards, written with a file for each episode, and packed again."""
    first = _written(spark, classes(spark, d), "3.0", data_mb=0.02)
    second = _written(spark, open_dataset(spark, first), "2.1")
    return _vectors(open_dataset(spark, _written(spark, open_dataset(spark, second), "3.0")))


@query(f"""with {_CLASSES} select cast(episode as bigint) as episode_index, cast(n as bigint) as length, cast(start as bigint) as dataset_from_index, cast(start + n as bigint) as dataset_to_index, 'class ' || label as task from c""")
def episode_table(spark: SparkSession, d: str) -> DataFrame:
    """The wide episode table of the packed layout."""
    root = _written(spark, classes(spark, d), "3.0")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes").select("episode_index", "length", "dataset_from_index", "dataset_to_index", F.col("tasks")[0].alias("task"))


@query("""select cast(i - 1 as bigint) as component, min(x) as min, max(x) as max, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, count(*) as count
from (select unnest(generate_series(1, 64)) as i, cast(unnest(embedding) as double) as x from embeddings) group by i""")
def written_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the whole dataset, merged from those of its episodes."""
    root = _written(spark, classes(spark, d), "3.0")
    s = files.read_json(spark, f"{root}/meta/stats.json")["embedding"]
    rows = [(i, float(a), float(b), float(m), float(v), int(s["count"][0])) for i, (a, b, m, v) in enumerate(zip(s["min"], s["max"], s["mean"], s["std"], strict=True))]
    return _rounded(spark.createDataFrame(rows, "component bigint, min double, max double, mean double, std double, count bigint"), "mean", "std", digits=5)


@query(f"""with {_CLASSES}, o as (select label, n, (case when label % 2 = 0 then 0 else 1 end) as source from c),
p as (select label, row_number() over (order by source, label) - 1 as episode, sum(n) over (order by source, label) - n as start from o)
select cast(p.episode as bigint) as episode_index, frame_index, cast(p.start + frame_index as bigint) as "index", cast(p.episode as bigint) as task_index, head, tail from r join p using (label)""")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Two written datasets, merged and read."""
    roots = [_written(spark, classes(spark, d, f"label % 2 = {k}"), "2.1") for k in (0, 1)]
    out = new_folder(spark, "merged")
    D.merge_datasets(spark, roots, out)
    return _vectors(open_dataset(spark, out))


@query(f"""with {_CLASSES}, k as (select label, dense_rank() over (order by label) - 1 as episode, sum(n) over (order by label) - n as start from c where episode % 3 <> 1)
select cast(k.episode as bigint) as episode_index, frame_index, cast(k.start + frame_index as bigint) as "index", cast(case when c.episode = 3 then (select count(*) from c) else c.episode end as bigint) as task_index, head, tail from r join k using (label) join c using (label)""")
def edit_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every third class deleted and one relabelled, written and read."""
    data = classes(spark, d)
    n = data.episodes.count()
    out = new_folder(spark, "edited")
    D.edit_dataset(spark, _written(spark, data, "3.0"), out, D.EditConfig(tuple(range(1, n, 3)), (), {3: "something else"}))
    return _vectors(open_dataset(spark, out))


@query(f"""with {_CLASSES} select cast(c.episode - 2 as bigint) as episode_index, frame_index, cast(c.start - (select start from c where episode = 2) + frame_index as bigint) as "index", cast(c.episode as bigint) as task_index, head, tail from r join c using (label) where c.episode >= 2 and c.episode < 6""")
def subset_plan(spark: SparkSession, d: str) -> DataFrame:
    """Four episodes as a dataset of their own, written and read."""
    return _vectors(open_dataset(spark, _written(spark, D.subset(open_dataset(spark, _written(spark, classes(spark, d), "2.1")), 2, 6), "3.0")))


@query("""select label as episode_index, count(*) as frames from embeddings where label in (1, 4, 7) group by label""")
def read_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Several episodes in one scan."""
    data = open_dataset(spark, _written(spark, classes(spark, d), "2.1"))
    return data.episodes_of([1, 4, 7]).groupBy("episode_index").agg(F.count(F.lit(1)).alias("frames"))


@query("""select 'missing_file' as code, count(*) as n from (select distinct label from embeddings where label % 4 = 1)
union all select 'file_rows', count(*) from (select distinct label from embeddings where label % 4 = 2)""")
def file_faults(spark: SparkSession, d: str) -> DataFrame:
    """Files taken away and files cut short, found by their names and footers."""
    root = _written(spark, classes(spark, d), "2.1")
    for e in range(10):
        path = f"{root}/data/chunk-000/episode_{e:06d}.parquet"
        if e % 4 == 1:
            files.delete(spark, path)
        elif e % 4 == 2:
            import pyarrow as pa
            import pyarrow.parquet as pq

            with stores.reader(files.qualified(spark, path)) as file:
                rows = pq.read_table(file)
            sink = pa.BufferOutputStream()
            pq.write_table(rows.slice(1), sink)
            stores.write(files.qualified(spark, path), 0, lambda out, sink=sink: out.write(sink.getvalue()))
    data = open_dataset(spark, root)
    return D.file_faults(spark, root, data).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_PACKETS = "sha256(string_agg(coalesce(text, ''), '' order by turn)) as digest"


@query(f"select cast(conv_id as bigint) as episode_index, 'screen' as camera, {_PACKETS} from conversations group by conv_id")
def video_chain(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every episode's packets after packing videos, unpacking and packing them."""
    first = _written(spark, filmed(spark, d), "3.0", video_mb=0.05)
    second = _written(spark, open_dataset(spark, first), "2.1")
    return jobs.video_digests(open_dataset(spark, _written(spark, open_dataset(spark, second), "3.0")))


@query(f"""select cast(dense_rank() over (order by conv_id) - 1 as bigint) as episode_index, 'screen' as camera, digest from (select conv_id, {_PACKETS} from conversations where conv_id % 4 <> 2 group by conv_id)""")
def video_edit(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the survivors' packets after episodes are deleted from packed videos."""
    data = filmed(spark, d)
    _, n = parse_split(data.info.splits["train"])
    out = new_folder(spark, "edited")
    D.edit_dataset(spark, _written(spark, data, "3.0", video_mb=0.05), out, D.EditConfig(tuple(range(2, n, 4))))
    return jobs.video_digests(open_dataset(spark, out))


@query(f"""with n as (select count(distinct conv_id) as n from conversations), p as (select conv_id, {_PACKETS} from conversations group by conv_id)
select cast(conv_id as bigint) as episode_index, 'screen' as camera, digest from p union all select cast(conv_id + n.n as bigint), 'screen', digest from p, n""")
def video_merge(spark: SparkSession, d: str) -> DataFrame:
    """Digests after a merge of two packed datasets."""
    data = filmed(spark, d)
    roots = [_written(spark, data, "3.0"), _written(spark, data, "3.0", video_mb=0.05)]
    out = new_folder(spark, "merged")
    D.merge_datasets(spark, roots, out)
    return jobs.video_digests(open_dataset(spark, out))


@query("""select 'missing_video' as code, count(*) as n from (select distinct conv_id from conversations where conv_id % 5 = 1)""")
def video_faults(spark: SparkSession, d: str) -> DataFrame:
    """Videos taken away, found by validation."""

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                stores.delete(path)
            yield batch

    data = open_dataset(spark, _written(spark, filmed(spark, d), "2.1"))
    jobs.slice_paths(data).where("episode_index % 5 = 1").select("path").repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(taken, "path string").count()
    return jobs.video_faults(data, deep=True).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(conv_id as bigint) as episode_index, 'differs' as status from (select distinct conv_id from conversations where conv_id % 7 = 3)""")
def compare_plan(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of which a frame was changed, as a comparison of two datasets finds them."""
    from .operators.compare import compare_frames

    data = open_dataset(spark, _written(spark, talks(spark, d), "2.1"))
    changed = data.frames.withColumn("task_index", F.when((F.col("episode_index") % 7 == 3) & (F.col("frame_index") == 0), F.col("task_index") + 1).otherwise(F.col("task_index")))
    found = compare_frames(data.frames, changed, ["episode_index", "frame_index"], tolerant=False)
    return found.where("status <> 'same'").select("episode_index", "status").distinct()


@query("""select cast(conv_id as bigint) as episode_index, count(*) as rows, count(*) as length from conversations group by conv_id""")
def footer_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each episode's file by its footer."""
    data = open_dataset(spark, _written(spark, talks(spark, d), "2.1"), frames=False)
    return data_profile(spark, data).select("episode_index", "rows", "length")


@query("""select count(distinct conv_id) as episodes, count(*) as rows, cast(1 as bigint) as files from conversations""")
def shard_profile(spark: SparkSession, d: str) -> DataFrame:
    """Data files of the packed layout with the episodes and rows in them."""
    data = open_dataset(spark, _written(spark, talks(spark, d), "3.0"))
    return data_resources(spark, data).agg(F.sum("episodes").alias("episodes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))


@query("select doc_id, cast(row_number() over (partition by lang order by n_chars desc, doc_id) - 1 as bigint) as turn from documents")
def largest_first(spark: SparkSession, d: str) -> DataFrame:
    return planning.largest_first(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), cost="n_chars", key="doc_id", by=["lang"]).select("doc_id", "turn")


@query("""select doc_id from (select doc_id, sum(n_chars) over w as upto, row_number() over w as n from documents where n_chars <= 9000 window w as (partition by lang order by n_chars, doc_id rows between unbounded preceding and current row)) where upto <= 9000 or n = 1""")
def head_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return planning.head_within(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), size="n_chars", key="doc_id", budget=9000, by=["lang"]).select("doc_id")


@query("""select o_custkey, min(o_orderkey) as o_orderkey from (select *, max(o_totalprice) over (partition by o_custkey) as peak from orders) where o_totalprice >= peak * 0.97 group by o_custkey""")
def least_near_peak(spark: SparkSession, d: str) -> DataFrame:
    return planning.least_near_peak(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), workers="o_orderkey", throughput="o_totalprice", by=["o_custkey"])


@query("""with recursive s as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
f(user_id, n, best, spot) as (select user_id, 1, case when value > 0 then value else 0.0 end, case when value > 0 then event_id end from s where n = 1
union all select s.user_id, s.n, case when s.value > f.best * 1.03 then s.value else f.best end, case when s.value > f.best * 1.03 then s.event_id else f.spot end from f join s on s.user_id = f.user_id and s.n = f.n + 1)
select user_id, arg_max(spot, n) as event_id from f group by user_id""")
def throughput_knee(spark: SparkSession, d: str) -> DataFrame:
    return planning.throughput_knee(_t(spark, d, "events").select("user_id", "event_id", "value"), workers="event_id", throughput="value", by=["user_id"])


@query("""with m(mount) as (values ('/'), ('/1'), ('/1/0'), ('/2'), ('/2/3')), p as (select event_id, '/' || (user_id % 4) || '/' || (event_id % 5) || '/x' as path from events)
select p.path, arg_max(m.mount, length(m.mount)) as mount from (select distinct path from p) p join m on m.mount = '/' or p.path = m.mount or starts_with(p.path, m.mount || '/') group by p.path""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    paths = _t(spark, d, "events").select(F.concat(F.lit("/"), (F.col("user_id") % 4).cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string"), F.lit("/x")).alias("path")).distinct()
    mounts = spark.createDataFrame([(m,) for m in ("/", "/1", "/1/0", "/2", "/2/3")], "mount string")
    return planning.longest_prefix(paths, mounts, path="path", mount="mount")


@query("""with m as (select user_id, avg(value) as m, stddev_pop(value) as s from events group by user_id)
select user_id, count(value) as n, cast(sum(case when s > 0 and abs(value - m) > 1.5 * s then 1 else 0 end) as bigint) as outliers, max(s) = 0 as constant from events join m using (user_id) group by user_id""")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.outliers(_t(spark, d, "events").select("user_id", "value"), by=["user_id"], value="value", sigmas=1.5)


@query("""with l as (select user_id, event_type, count(*) as length from events group by all), t as (select event_type, count(*) as episodes, cast(sum(length) as bigint) as frames from l group by event_type)
select event_type, episodes, frames, round(frames / (select sum(frames) from t), 6) as share, (select max(frames) from t) > 1.02 * frames as rare from t""")
def imbalance(spark: SparkSession, d: str) -> DataFrame:
    lengths = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("length"))
    return _rounded(quality.imbalance(lengths, by="event_type", ratio=1.02), "share")


@query("""select conv_id, count(*) as length from conversations group by conv_id having count(*) < 5""")
def policy_window(spark: SparkSession, d: str) -> DataFrame:
    return quality.too_short(_t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), window=5)


@query("""select round(sum(e), 3) as logical, greatest(1, cast(sum(e) as bigint) // count(*)) as per_row from (select n_chars as e from documents)""")
def bytes_per_row(spark: SparkSession, d: str) -> DataFrame:
    from .plans.planner import bytes_per_row as per_row

    whole = _t(spark, d, "documents").agg(F.sum("n_chars").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([(float(whole["b"] or 0), per_row(whole["b"] or 0, whole["n"]))], "logical double, per_row bigint")
