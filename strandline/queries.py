"""Queries over the test tables, one for each operator or small group, and the SQL that gives the same rows.

Episodes are conversations (frame = turn, task = role), users of ``events``
(clock = ts, scalar = value), labels of ``embeddings`` (vector = embedding) or
orders (frames = line items).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import natural_key, nested_close, numeric_stem
from .functions.statmaps import constant_stats, flatten_stats, shift_stats
from .operators import align, compare, edit, index, media_plan, merge, pack, quality, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


_EP = "ep as (select conv_id, count(*) as length from conversations group by conv_id)"


@query("select user_id, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as count from events group by user_id")
def episode_stats_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.scalar_stats(_t(spark, d, "events"), ["user_id"], "value"), "mean", "std")


@query("""select label, component, round(min(x), 6) as min, round(max(x), 6) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, count(*) as count
from (select label, unnest(generate_series(0, len(embedding) - 1)) as component, cast(unnest(embedding) as double) as x from embeddings) group by label, component""")
def episode_stats_vector(spark: SparkSession, d: str) -> DataFrame:
    out = stats.vector_stats(_t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"], "embedding")
    return _rounded(out, "min", "max", "mean", "std").withColumn("component", F.col("component").cast("bigint"))


_MOMENTS = """with e as (select user_id, avg(value) as m, var_pop(value) as v, count(*) as n, min(value) as mn, max(value) as mx from events group by user_id),
t as (select sum(m * n) / sum(n) as gm from e)
select round(max(t.gm), 6) as mean, round(sqrt(sum((e.v + (e.m - t.gm) * (e.m - t.gm)) * e.n) / sum(e.n)), 6) as std, cast(sum(n) as bigint) as count, min(mn) as min, max(mx) as max from e cross join t"""


@query(_MOMENTS)
def merge_moments(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.merge_moments(stats.scalar_stats(_t(spark, d, "events"), ["user_id"], "value")), "mean", "std")


@query("select event_type, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99 from events group by event_type")
def quantile_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.quantile_stats(_t(spark, d, "events"), ["event_type"], "value", {"q01": 0.01, "q50": 0.5, "q99": 0.99}), "q01", "q50", "q99")


@query("""with a as (select user_id, event_type, quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.99) as q99 from events group by all)
select event_type, 'q01' as quantile, round(min(q01), 6) as value from a group by event_type union all select event_type, 'q99', round(max(q99), 6) from a group by event_type""")
def quantile_envelope(spark: SparkSession, d: str) -> DataFrame:
    parts = stats.quantile_stats(_t(spark, d, "events"), ["user_id", "event_type"], "value", {"q01": 0.01, "q99": 0.99})
    long = parts.unpivot(["user_id", "event_type"], ["q01", "q99"], "quantile", "value")
    return _rounded(stats.quantile_envelope(long, "event_type", "quantile", "value", "user_id"), "value")


@query(f"""with {_EP} select conv_id, length, cast(coalesce(sum(length) over (order by conv_id rows between unbounded preceding and 1 preceding), 0) as bigint) as dataset_from_index,
cast(sum(length) over (order by conv_id rows between unbounded preceding and current row) as bigint) as dataset_to_index from ep""")
def global_offsets(spark: SparkSession, d: str) -> DataFrame:
    return index.running_offsets(_episodes(spark, d), "conv_id", "length")


@query("""with e as (select user_id, row_number() over (order by user_id) - 1 as episode_index, count(*) as n from events group by user_id),
o as (select user_id, episode_index, coalesce(sum(n) over (order by user_id rows between unbounded preceding and 1 preceding), 0) as f from e),
t as (select event_type, row_number() over (order by event_type) - 1 as task_index from (select distinct event_type from events))
select event_id, cast(o.episode_index as bigint) as episode_index, cast(x.fi as bigint) as frame_index, cast(o.f + x.fi as bigint) as index,
round(cast(cast(x.fi / 30.0 as float) as double), 5) as timestamp, cast(t.task_index as bigint) as task_index
from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as fi from events) x join o using (user_id) join t using (event_type)""")
def generated_columns(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    placed = index.dense_rank_of(index.running_offsets(users, "user_id", "length"), "user_id", "episode_index")
    tasks = index.task_dictionary(events.select("event_type", F.col("event_type").alias("o")), "event_type", ["o"])
    framed = events.join(F.broadcast(tasks.withColumnRenamed("task_index", "t")), "event_type")
    out = index.generated_columns(framed, placed, episode="user_id", order=["ts", "event_id"], fps=30, task=F.col("t"))
    return _rounded(out.select("event_id", "episode_index", "frame_index", "index", "timestamp", "task_index"), "timestamp", digits=5)


@query("select role, row_number() over (order by min({'a': conv_id, 'b': turn})) - 1 as task_index from conversations group by role")
def task_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index.task_dictionary(_t(spark, d, "conversations"), "role", ["conv_id", "turn"])


def _two_sources(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    second = (F.col("conv_id") >= 50).cast("int")
    return c.select(second.alias("source_ordinal"), (F.col("conv_id") - second * 50).alias("local_episode"), F.col("turn").alias("frame_index"), "role")


_TWO = "x as (select cast(conv_id >= 50 as int) as src, conv_id - 50 * cast(conv_id >= 50 as int) as ep, turn, role from conversations)"


@query(f"""with {_TWO}, e as (select src, ep, count(*) as len from x group by src, ep),
o as (select src, ep, row_number() over (order by src, ep) - 1 as n, coalesce(sum(len) over (order by src, ep rows between unbounded preceding and 1 preceding), 0) as st from e)
select x.src as source_ordinal, x.ep as local_episode, x.turn as frame_index, cast(o.n as bigint) as episode_index, cast(o.st + x.turn as bigint) as index from x join o using (src, ep)""")
def merge_reindex(spark: SparkSession, d: str) -> DataFrame:
    frames = _two_sources(spark, d)
    episodes = frames.groupBy("source_ordinal", "local_episode").agg(F.count(F.lit(1)).alias("length"))
    return merge.merge_frames(frames.drop("role"), episodes)


@query(f"""with {_TWO}, k as (select src, role as task, row_number() over (partition by src order by case when src = 0 then role end, case when src = 1 then role end desc) - 1 as li from (select distinct src, role from x)),
f as (select task, row_number() over (order by min(src * 1000 + li)) - 1 as ti from k group by task)
select src as source_ordinal, cast(li as bigint) as local_index, task, cast(ti as bigint) as task_index from k join f using (task)""")
def merged_tasks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    texts = _two_sources(spark, d).select("source_ordinal", F.col("role").alias("task")).distinct()
    first, second = texts.where("source_ordinal = 0"), texts.where("source_ordinal = 1")
    local = first.withColumn("local_index", (F.row_number().over(Window.partitionBy("source_ordinal").orderBy("task")) - 1).cast("bigint")).unionByName(second.withColumn("local_index", (F.row_number().over(Window.partitionBy("source_ordinal").orderBy(F.desc("task"))) - 1).cast("bigint")))
    return index.merged_task_dictionary(local)


@query(f"with {_TWO}, e as (select src, ep, count(*) as len from x group by src, ep) select src as source_ordinal, count(*) as episodes, cast(sum(len) as bigint) as frames from e group by src")
def merge_contributions(spark: SparkSession, d: str) -> DataFrame:
    return merge.contributions(_two_sources(spark, d).groupBy("source_ordinal", "local_episode").agg(F.count(F.lit(1)).alias("length")))


@query(f"""with recursive {_EP}, n as (select conv_id, length, row_number() over (order by conv_id) as rn from ep),
r as (select conv_id, length, rn, 0 as file_index, length as s from n where rn = 1 union all
select n.conv_id, n.length, n.rn, case when r.s + n.length >= 20 then r.file_index + 1 else r.file_index end, case when r.s + n.length >= 20 then n.length else r.s + n.length end from r join n on n.rn = r.rn + 1)
select conv_id, length, file_index from r""")
def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.greedy_pack(_episodes(spark, d), key="conv_id", size="length", limit=20)


@query(f"with {_EP} select conv_id, length, cast(ntile(7) over (order by conv_id) - 1 as int) as part from ep")
def even_intervals(spark: SparkSession, d: str) -> DataFrame:
    return pack.even_intervals(_episodes(spark, d), key="conv_id", count=7)


@query("""with a as (select user_id, ts, event_id from events where event_type = 'click'), p as (select user_id, ts, event_id, value from events where event_type = 'purchase'),
f as (select user_id, arg_min(value, {'a': ts, 'b': event_id}) as v from p group by user_id)
select a.user_id, a.event_id, coalesce(p.value, f.v) as value from a asof left join p on a.user_id = p.user_id and a.ts >= p.ts left join f on f.user_id = a.user_id""")
def asof_clamped(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return align.asof_clamped(clicks, bought, by=["user_id"], on="ts", value="value", tie=["event_id"]).select("user_id", "event_id", "value")


@query("""with r as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rk from events where event_type in ('click', 'view')),
m as (select user_id, min(n) as m, count(*) as k from (select user_id, event_type, count(*) as n from r group by all) group by user_id)
select a.user_id, m.m - a.rk as frame_index, a.event_id as click, b.event_id as view from r a join r b on a.user_id = b.user_id and a.rk = b.rk join m on m.user_id = a.user_id
where a.event_type = 'click' and b.event_type = 'view' and a.rk <= m.m and m.k = 2""")
def tail_align(spark: SparkSession, d: str) -> DataFrame:
    return align.tail_align(_t(spark, d, "events"), by=["user_id"], stream="event_type", names=["click", "view"], order=["ts", "event_id"], value="event_id")


@query("""with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events where event_type in ('click', 'view'))
select a.user_id, a.n as frame_index, [a.value, a.value, b.value, b.value] as state from r a join r b on a.user_id = b.user_id and a.n = b.n and a.event_type = 'click' and b.event_type = 'view'""")
def stream_concat(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = _t(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    ranked = e.withColumn("frame_index", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("bigint"))
    arm = lambda k: F.max(F.when(F.col("event_type") == k, F.array("value", "value")))
    both = ranked.groupBy("user_id", "frame_index").agg(arm("click").alias("left"), arm("view").alias("right")).where("left is not null and right is not null")
    return both.select("user_id", "frame_index", F.concat("left", "right").alias("state"))


@query("""with surv as (select distinct conv_id from conversations where conv_id % 3 <> 1), sp as (select 'train' as split, 0 as a, 80 as b union all select 'val', 80, 100)
select split, cast(sum(case when conv_id < a then 1 else 0 end) as bigint) as start, cast(sum(case when conv_id < b then 1 else 0 end) as bigint) as stop from sp cross join surv group by split""")
def split_remap(spark: SparkSession, d: str) -> DataFrame:
    kept = _episodes(spark, d).where("conv_id % 3 <> 1").select("conv_id")
    splits = spark.createDataFrame([("train", 0, 80), ("val", 80, 100)], "split string, start bigint, stop bigint")
    return index.remap_splits(splits, kept, episode="conv_id")


@query("""with k as (select distinct conv_id from conversations where conv_id % 5 <> 2), g as (select conv_id, conv_id - row_number() over (order by conv_id) as grp from k)
select min(conv_id) as start, max(conv_id) + 1 as stop from g group by grp""")
def range_islands(spark: SparkSession, d: str) -> DataFrame:
    return index.islands(_t(spark, d, "conversations").where("conv_id % 5 <> 2"), "conv_id")


@query("""select conv_id, count(*) as length, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous
from conversations where not (conv_id % 7 = 3 and turn = 1) group by conv_id""")
def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    return index.contiguity(_t(spark, d, "conversations").where("not (conv_id % 7 = 3 and turn = 1)"), "conv_id", "turn")


@query(f"""with {_EP}, a as (select list(length order by length) as a from ep)
select cast(len(a) as bigint) as count, cast(list_sum(a) as bigint) as total, a[1] as min, a[cast(1 + least(len(a) - 1, round_even((len(a) - 1) * 0.5, 0)) as int)] as p50,
a[cast(1 + least(len(a) - 1, round_even((len(a) - 1) * 0.95, 0)) as int)] as p95, a[len(a)] as max from a""")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(_episodes(spark, d), "length", {"p50": 0.5, "p95": 0.95})


@query("select conv_id, sha256(string_agg(text, '' order by turn)) as digest from conversations group by conv_id")
def ordered_payload_digest(spark: SparkSession, d: str) -> DataFrame:
    return compare.payload_digest(_t(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("select sha256(text) as digest, count(*) as copies, min(doc_id) as first_key from documents group by text having count(*) > 1")
def duplicate_payloads(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_payloads(_t(spark, d, "documents"), "text", "doc_id")


@query("""select user_id, event_id, round(s, 6) as step from (select *, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as s from events) where s > 200""")
def value_jumps(spark: SparkSession, d: str) -> DataFrame:
    out = quality.value_jumps(_t(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], value="value", threshold=200.0)
    return _rounded(out.select("user_id", "event_id", "step"), "step")


@query("""select user_id, event_id, round(g, 6) as gap from (select *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) as g from events) where abs(g - 3600.0) > 1800.0 or g <= 0""")
def temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return _rounded(quality.temporal_gaps(e, by=["user_id"], order=["ts", "event_id"], seconds=F.col("s"), fps=1 / 3600).select("user_id", "event_id", "gap"), "gap")


@query("""select user_id, cast(count(*) filter (value is null) as bigint) as missing, cast(0 as bigint) as non_finite, cast(count(*) filter (value <= 1 or value >= 400) as bigint) as clipped, coalesce(stddev_pop(value) = 0, true) as frozen from events group by user_id""")
def value_faults(spark: SparkSession, d: str) -> DataFrame:
    return quality.value_faults(_t(spark, d, "events"), by=["user_id"], value="value", low=1.0, high=400.0)


@query("select event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) as field from events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    field = F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))")
    return _t(spark, d, "events").select("event_id", "event_type", field.alias("field"))


@query("""with s as (select conv_id, count(*) as len from conversations where conv_id % 4 <> 1 group by conv_id),
o as (select conv_id, row_number() over (order by conv_id) - 1 as n, coalesce(sum(len) over (order by conv_id rows between unbounded preceding and 1 preceding), 0) as st from s)
select cast(o.n as bigint) as conv_id, c.turn, cast(o.st + c.turn as bigint) as index from conversations c join o using (conv_id)""")
def delete_and_reindex(spark: SparkSession, d: str) -> DataFrame:
    episodes = _episodes(spark, d)
    survivors = edit.surviving_episodes(episodes, episodes.where("conv_id % 4 = 1"), episode="conv_id")
    return edit.delete_episodes(_t(spark, d, "conversations").select("conv_id", "turn"), survivors, episode="conv_id", frame="turn")


@query("""with t as (select role, row_number() over (order by role) - 1 as id from (select distinct role from conversations)),
ov as (select 3 as conv_id, 'novel' as task union all select 5, 'user' union all select 9, 'another'),
nt as (select role, id from t union all select task, (select max(id) from t) + row_number() over (order by min(conv_id)) from ov where task not in (select role from t) group by task)
select c.conv_id, c.turn, cast(coalesce(n2.id, n1.id) as bigint) as task_index from conversations c join t n1 on n1.role = c.role left join ov on ov.conv_id = c.conv_id left join nt n2 on n2.role = ov.task""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    tasks = index.task_dictionary(c.select(F.col("role").alias("task"), F.col("role").alias("o")), "task", ["o"])
    overrides = spark.createDataFrame([(3, "novel"), (5, "user"), (9, "another")], "conv_id bigint, task string")
    _, override = edit.relabelled_tasks(tasks, overrides, episode="conv_id")
    frames = c.join(F.broadcast(tasks), c["role"] == tasks["task"]).select("conv_id", "turn", "task_index")
    return edit.relabel(frames, override, episode="conv_id")


@query("select event_id, ts, user_id, event_type, value from events")
def drop_feature(spark: SparkSession, d: str) -> DataFrame:
    return edit.drop_features(_t(spark, d, "events"), ["props"])


@query("select event_id, user_id, cast(value as float) as value, cast(round(value) as bigint) as level from events")
def canonical_cast(spark: SparkSession, d: str) -> DataFrame:
    wide = _t(spark, d, "events").select("event_id", "user_id", "value", F.round("value").alias("level"))
    return edit.canonical(wide, {"value": "float", "level": "bigint"})


@query("""with f as (select user_id as episode_index, event_id, row_number() over (order by user_id, ts, event_id) - 1 as i from events)
select episode_index - 20 as episode_index, event_id, i - (select min(i) from f where episode_index >= 20 and episode_index < 40) as index from f where episode_index >= 20 and episode_index < 40""")
def subset_rebase(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    users = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    placed = index.dense_rank_of(index.running_offsets(users, "user_id", "length"), "user_id", "episode_index")
    frames = index.generated_columns(e, placed, episode="user_id", order=["ts", "event_id"], fps=1).select(F.col("user_id").alias("episode_index"), "event_id", "index")
    return index.subset(frames, 20, 40)


_PERTURBED = "r as (select event_id + case when event_id % 997 = 5 then 1000000 else 0 end as event_id, value + case when event_id % 101 = 7 then 1.0 when event_id % 103 = 2 then 1e-8 else 0 end as value from events)"


@query(f"""with l as (select event_id, value from events), {_PERTURBED}
select coalesce(l.event_id, r.event_id) as event_id, case when l.event_id is null then 'right_only' when r.event_id is null then 'left_only'
when l.value is null and r.value is null then 'same' when l.value is null or r.value is null or abs(l.value - r.value) > 1e-7 + 1e-6 * abs(r.value) then 'differs' else 'same' end as status from l full outer join r on l.event_id = r.event_id""")
def compare_full_outer(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "events").select("event_id", "value")
    moved = F.col("event_id") + F.when(F.col("event_id") % 997 == 5, 1000000).otherwise(0)
    changed = F.col("value") + F.when(F.col("event_id") % 101 == 7, 1.0).when(F.col("event_id") % 103 == 2, 1e-8).otherwise(0.0)
    return compare.compare_frames(left, left.select(moved.alias("event_id"), changed.alias("value")), ["event_id"])


@query(f"""with l as (select event_id, value from events), {_PERTURBED}
select coalesce(l.event_id, r.event_id) as event_id, case when l.event_id is null then 'right_only' when r.event_id is null then 'left_only' else 'differs' end as status from l full outer join r on l.event_id = r.event_id
where l.event_id is null or r.event_id is null or abs(l.value - r.value) > 1e-7 + 1e-6 * abs(r.value) order by 1 limit 50""")
def first_errors(spark: SparkSession, d: str) -> DataFrame:
    return compare.first_differences(compare_full_outer(spark, d), ["event_id"])


@query("""with l as (select l_orderkey, l_linenumber, l_quantity from lineitem), r as (select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 5 <> 0 union all select l_orderkey, 1, 1.0 from lineitem where l_orderkey % 7 = 0),
u as (select *, 1 as n from l union all select *, -1 from r)
select l_orderkey, l_linenumber, round(l_quantity, 6) as l_quantity, cast(sum(n) as bigint) as surplus from u group by all having sum(n) <> 0""")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    more = left.where("l_orderkey % 7 = 0").select("l_orderkey", F.lit(1).cast(left.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return compare.multiset_difference(left, left.where("l_orderkey % 5 <> 0").unionByName(more))


@query("""select user_id, round(min(value) + 10.5, 6) as min, round(max(value) + 10.5, 6) as max, round(avg(value) + 10.5, 6) as mean, round(stddev_pop(value), 6) as std, count(*) as count from events group by user_id""")
def shifted_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.scalar_stats(_t(spark, d, "events"), ["user_id"], "value")
    moved = shift_stats({k: F.col(k) for k in ("min", "max", "mean", "std", "count")}, F.lit(10.5))
    return _rounded(s.select("user_id", *(v.alias(k) for k, v in moved.items())), "min", "max", "mean", "std")


@query(f"with {_EP} select conv_id, cast(conv_id as double) as min, cast(conv_id as double) as max, cast(conv_id as double) as mean, 0.0::double as std, length as count from ep")
def constant_column_stats(spark: SparkSession, d: str) -> DataFrame:
    made = constant_stats(F.col("conv_id"), F.col("length"), ("min", "max", "mean", "std", "count"))
    return _episodes(spark, d).select("conv_id", *(v.alias(k) for k, v in made.items()))


@query("""select user_id, round(min(value), 6) as "stats/value/min", round(max(value), 6) as "stats/value/max", cast(null as double) as "stats/other/min", cast(null as double) as "stats/other/max" from events group by user_id""")
def flatten_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = _rounded(stats.scalar_stats(_t(spark, d, "events"), ["user_id"], "value"), "min", "max")
    nested = s.select("user_id", F.create_map(F.lit("value"), F.create_map(F.lit("min"), F.col("min"), F.lit("max"), F.col("max"))).alias("stats"))
    return flatten_stats(nested, "stats", ("value", "other"), ("min", "max"))


@query("""with m as (select *, case when abs(value - lag(value) over (partition by user_id order by ts, event_id)) > 30 then 1 else 0 end as mv, row_number() over (partition by user_id order by ts, event_id) as rn from events),
b as (select user_id, min(case when mv = 1 then rn end) as a, max(case when mv = 1 then rn end) as z from m group by user_id)
select m.event_id, m.rn - b.a as frame_index from m join b on m.user_id = b.user_id where m.rn between b.a and b.z""")
def trim_static(spark: SparkSession, d: str) -> DataFrame:
    return quality.trim_static(_t(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], value="value", threshold=30.0).select("event_id", "frame_index")


@query("""with m as (select user_id, value, coalesce(cast(abs(value - lag(value) over (partition by user_id order by ts, event_id)) > 200 as int), 0) as j from events),
a as (select user_id, count(*) as length, cast(sum(j) as bigint) as jumps, cast(coalesce(stddev_pop(value), 0) > 0 as int) as moves from m group by user_id)
select user_id, length, jumps, round(0.5 * (1 - jumps / length) + 0.3 * moves + 0.2 * least(1.0, length / 80.0), 6) as score,
concat_ws(',', case when jumps > 0 then 'jumps' end, case when moves = 0 then 'frozen' end, case when length < 80 then 'short' end) as reasons from a""")
def episode_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.episode_score(_t(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], value="value", jump=200.0, short=80), "score")


@query("select event_id, n - 1 as frame_index, round(cast(cast((n - 1) / 20.0 as float) as double), 5) as timestamp from (select event_id, row_number() over (partition by user_id order by ts, event_id) as n from events)")
def fix_timestamps(spark: SparkSession, d: str) -> DataFrame:
    fixed = quality.fix_timestamps(_t(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], fps=20)
    return _rounded(fixed.select("event_id", "frame_index", "timestamp"), "timestamp", digits=5)


@query("""with v as (select *, case when event_id % 5 = 0 then null else value end as g from events),
w as (select *, last_value(g ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as b,
first_value(g ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as a from v) select event_id, coalesce(b, a) as value from w""")
def fix_nan(spark: SparkSession, d: str) -> DataFrame:
    broken = _t(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return quality.fix_nan(broken, by=["user_id"], order=["ts", "event_id"], value="value").select("event_id", "value")


@query("select conv_id, count(*) as length, count(*) < 5 as short from conversations group by conv_id")
def episode_lengths(spark: SparkSession, d: str) -> DataFrame:
    return quality.episode_lengths(_t(spark, d, "conversations"), ["conv_id"], short=5)


@query("select count(distinct len(embedding)) as embedding from embeddings")
def vector_consistency(spark: SparkSession, d: str) -> DataFrame:
    return quality.consistency(_t(spark, d, "embeddings"), ["embedding"])


@query("""with c as (select user_id, avg(value) as mean, stddev_pop(value) as std from events group by user_id), s as (select user_id, mean + case when user_id % 10 = 3 then 0.5 when user_id % 10 = 4 then 1e-9 else 0.0 end as mean, std from c),
j as (select coalesce(s.user_id, c.user_id) as user_id, s.mean as a, c.mean as b, s.std as x, c.std as y from s full outer join c using (user_id))
select user_id, 'differs' as status from j where abs(a - b) > 1e-7 + 1e-6 * abs(b) or abs(x - y) > 1e-7 + 1e-6 * abs(y)""")
def statistics_drift(spark: SparkSession, d: str) -> DataFrame:
    computed = stats.scalar_stats(_t(spark, d, "events"), ["user_id"], "value")
    stored = computed.withColumn("mean", F.col("mean") + F.when(F.col("user_id") % 10 == 3, 0.5).when(F.col("user_id") % 10 == 4, 1e-9).otherwise(0.0))
    return quality.statistics_drift(stored, computed, ["user_id"])


@query("""with p as (select label, vec_id, cast(vec_id as double) / 10 as t, unnest(generate_series(0, 63)) as component, cast(unnest(embedding) as double) as position from embeddings),
s as (select *, (position - lag(position) over w) / (t - lag(t) over w) as speed from p where component < 3 window w as (partition by label, component order by vec_id))
select label, vec_id, cast(component as int) as component, round(position, 6) as position, round(speed, 6) as speed from s where position < -0.2 or position > 0.2 or abs(speed) > 0.5""")
def kinematic_limits(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") / 10.0).cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("embedding"))
    limits = spark.createDataFrame([(k, -0.2, 0.2, 0.5) for k in range(3)], "component int, low double, high double, max_speed double")
    out = quality.kinematic_violations(e, limits, by=["label"], order=["vec_id"], vector="embedding", seconds="t")
    return _rounded(out, "position", "speed")


@query("select coalesce(o.o_orderkey, l.k) as o_orderkey, l.n as rows from orders o full outer join (select l_orderkey as k, count(*) as n from lineitem group by 1) l on o.o_orderkey = l.k")
def file_rows_vs_metadata(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare.file_rows(_t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("""select doc_id, cast(coalesce(sum(n_chars) over (partition by lang, doc_id // 100 order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as from_timestamp,
cast(sum(n_chars) over (partition by lang, doc_id // 100 order by doc_id rows between unbounded preceding and current row) as bigint) as to_timestamp from documents""")
def media_offsets(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / 100).alias("file"))
    return index.media_offsets(files, camera="lang", file="file", order="doc_id", duration="n_chars").select("doc_id", "from_timestamp", "to_timestamp")


@query("""select doc_id, cast(s - min(s) over (partition by lang, doc_id // 100) as bigint) as row_start from (select *, sum(n_chars) over (order by doc_id rows between unbounded preceding and current row) - n_chars as s from documents)""")
def file_first_offset(spark: SparkSession, d: str) -> DataFrame:
    placed = index.running_offsets(_t(spark, d, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / 100).alias("file")), "doc_id", "n_chars")
    return index.first_offset(placed, chunk="lang", file="file").select("doc_id", "row_start")


@query("""select d.doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id) as labelled from documents d""")
def semi_anti_labels(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("""select e.event_id, r.id from events e join (select conv_id as id, conv_id * 90 as start, conv_id * 90 + 60 as stop from (select distinct conv_id from conversations)) r on e.event_id >= r.start and e.event_id < r.stop""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    ranges = _episodes(spark, d).select(F.col("conv_id").alias("id"), (F.col("conv_id") * 90).alias("start"), (F.col("conv_id") * 90 + 60).alias("stop"))
    return align.range_join(_t(spark, d, "events").select("event_id"), ranges, key="event_id").select("event_id", "id")


@query("select doc_id, cast(doc_id // 1000 as bigint) as chunk, cast(doc_id % 1000 as bigint) as file from documents")
def chunk_location(spark: SparkSession, d: str) -> DataFrame:
    chunk, file = index.location(F.col("doc_id"), 1000)
    return _t(spark, d, "documents").select("doc_id", chunk.alias("chunk"), file.alias("file"))


@query("""select p_partkey, lpad(cast(p_partkey as varchar), 20, '0') as part, cast(p_partkey as double) / 4 as stem from part""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("/a/"), (F.col("p_partkey") / 4).cast("string"), F.lit(".json")).alias("path"))
    return parts.select("p_partkey", natural_key(F.col("p_partkey").cast("string")).alias("part"), numeric_stem("path").alias("stem"))


@query("""select event_id, abs(value - (value + 1e-8)) <= 1e-7 + 1e-6 * abs(value + 1e-8) as close, abs(value - value * 1.01) <= 1e-7 + 1e-6 * abs(value * 1.01) as far from events where value is not null""")
def tolerant_equality(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _t(spark, d, "events").where("value is not null").select("event_id", nested_close(v, v + 1e-8).alias("close"), nested_close(v, v * 1.01).alias("far"))


@query(f"""with {_EP}, e as (select conv_id as episode_index, case when conv_id % 11 = 4 then length + 1 else length end as length from ep where conv_id <> 2),
f as (select conv_id as episode_index, turn + case when conv_id % 13 = 5 then 1 else 0 end as frame_index from conversations where conv_id % 17 <> 6),
c as (select episode_index, count(*) as n, min(frame_index) as lo, max(frame_index) as hi, count(distinct frame_index) as d from f group by episode_index),
w as (select count(*) as n, sum(length) as f, min(episode_index) as a, max(episode_index) as b, count(distinct episode_index) as d from e)
select 'row_count' as code, coalesce(e.episode_index, c.episode_index) as episode_index, 'metadata says ' || coalesce(cast(e.length as varchar), 'nothing') || ', there are ' || coalesce(c.n, 0) as message
from e full outer join c on c.episode_index = e.episode_index where coalesce(e.length, -1) <> coalesce(c.n, 0)
union all select 'frame_index', episode_index, 'frames are not numbered from 0 without gaps' from c where lo <> 0 or hi <> n - 1 or d <> n
union all select 'episode_indices', null, 'episodes are not numbered from 0 without gaps' from w where a <> 0 or b <> n - 1 or d <> n
union all select 'total_episodes', null, 'metadata says 5, there are ' || n from w where n <> 5
union all select 'total_frames', null, 'metadata says 7, lengths sum to ' || f from w where f <> 7""")
def validation(spark: SparkSession, d: str) -> DataFrame:
    moved = (F.col("turn") + F.when(F.col("conv_id") % 13 == 5, 1).otherwise(0)).alias("frame_index")
    frames = _t(spark, d, "conversations").where("conv_id % 17 <> 6").select(F.col("conv_id").alias("episode_index"), moved)
    length = F.col("length") + F.when(F.col("conv_id") % 11 == 4, 1).otherwise(0)
    episodes = _episodes(spark, d).where("conv_id <> 2").select(F.col("conv_id").alias("episode_index"), length.alias("length"))
    return compare.validation_errors(frames, episodes, total_episodes=5, total_frames=7)


@query(f"with {_EP} select conv_id, length from ep order by conv_id limit 10")
def episode_preview(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).orderBy("conv_id").limit(10)


@query("""with s as (select doc_id, doc_id // 50 as file, (doc_id % 50) * 2.0 + case when doc_id % 17 = 3 then 0.013 else 0 end as start, (doc_id % 50) * 2.0 + case when doc_id % 13 = 4 then 2.5 else 2.0 end as stop from documents)
select doc_id, fault from (select *, case when abs(start * 30 - round(start * 30)) > 0.01 then 'off_frame' when start < 0 or stop > 99.5 + 1e-7 then 'outside' when start < lag(stop) over (partition by file order by start, stop) - 1e-7 then 'overlap' end as fault from s) where fault is not null""")
def slice_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    slices = _t(spark, d, "documents").select("doc_id", F.floor(k / 50).alias("file"), ((k % 50) * 2.0 + F.when(k % 17 == 3, 0.013).otherwise(0.0)).alias("start"), ((k % 50) * 2.0 + F.when(k % 13 == 4, 2.5).otherwise(2.0)).alias("stop"), F.lit(99.5).alias("duration"))
    return media_plan.slice_faults(slices, file="file", start="start", stop="stop", fps=30, duration="duration").select("doc_id", "fault")


@query("""with s as (select doc_id // 20 as file, n_chars, case when (doc_id // 20) % 4 = 0 then false when (doc_id // 20) % 4 = 1 then doc_id % 3 <> 0 else true end as kept, (doc_id // 20) % 3 <> 2 as safe, (doc_id // 20) % 11 = 7 as pixels from documents),
g as (select file, sum(n_chars) as frames, sum(case when kept then n_chars else 0 end) as kept_frames, bool_and(safe) as safe, bool_or(pixels) as pixels from s group by file)
select file, cast(frames as bigint) as frames, cast(kept_frames as bigint) as kept_frames, case when kept_frames = 0 then 'drop' when pixels then 'transcode' when kept_frames = frames then 'reuse' when safe then 'remux' else 'transcode' end as mode from g""")
def media_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    slices = _t(spark, d, "documents").select("doc_id", "n_chars", F.floor(k / 20).alias("file"))
    group = F.col("file") % 4
    kept = slices.where(F.when(group == 0, False).when(group == 1, k % 3 != 0).otherwise(True))
    return media_plan.media_modes(slices, kept, file="file", key="doc_id", frames="n_chars", changes_pixels=F.col("file") % 11 == 7, keyframe_safe=F.col("file") % 3 != 2)


@query("select source as source, max(n_chars) as bytes, count(*) as uses from documents group by source")
def resource_profile(spark: SparkSession, d: str) -> DataFrame:
    return media_plan.resource_profile(_t(spark, d, "documents"), resource="source", size="n_chars")


@query("select source, max(n_chars) as needed from documents group by source")
def longest_needed(spark: SparkSession, d: str) -> DataFrame:
    return media_plan.longest_needed(_t(spark, d, "documents"), file="source", stop="n_chars")


@query("""with p as (select label, cast(abs(vec_id * 7 % 256) as bigint) as x from embeddings)
select label, min(x) / 255.0 as min, max(x) / 255.0 as max, round(avg(x) / 255.0, 6) as mean, round(stddev_pop(x) / 255.0, 6) as std, count(*) as count from p group by label""")
def pixel_stats(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "embeddings").select("label", F.abs(F.col("vec_id") * 7 % 256).alias("x"))
    moments = x.groupBy("label").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return _rounded(media_plan.pixel_stats(moments, ["label"]), "mean", "std")
