"""The engine's operators applied to whole test tables, each with the SQL that must give the same rows.

Roles of the tables: an embedding is an object and its label the reduction; an event is a measurement, its type the
experiment, user_id % 4 the rank and (ts, event_id) the order of arrival.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.functions import ids, vectors
from convoke.functions.hashing import MULTIPLIER, SHIFT, buffer_hash64
from convoke.operators import benchstats as B
from convoke.operators import collect as C
from convoke.operators import coverage as V
from convoke.operators import objects as O
from convoke.operators import reduce as R
from convoke.operators import training as T
from convoke.plans import topology
from convoke.sources import logs
from convoke.sources.tables import table
from convoke.streaming import quota

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("vec"), "label")


def members(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select(F.col("label").alias("reduction_id"), "object_id", F.col("object_id").alias("ord"))


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("object_id", "vec")


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Events as measurements: seconds is null for every seventh, as for a line without one."""
    sec = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("test"), (F.col("user_id") % 4).alias("rank"), sec.alias("seconds"))


MEASURED = "(select event_id, ts, event_type as test, user_id % 4 as rank, case when event_id % 7 <> 0 then value end as seconds from events)"
CELLS = "(select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as pos from embeddings)"


def r(c, n: int = 6):
    return F.round(c, n)


# --- reductions


@query(f"select label, pos, round(sum(x), 6) as value from {CELLS} group by all")
def reduce_sum(spark, d):
    return R.reduce_cells(objects(spark, d), ["label"]).withColumn("value", r("value"))


@query(f"select label, pos, round(min(x), 6) as value from {CELLS} group by all")
def reduce_min(spark, d):
    return R.reduce_cells(objects(spark, d), ["label"], op="min").withColumn("value", r("value"))


@query(f"select label, pos, round(max(x), 6) as value from {CELLS} group by all")
def reduce_max(spark, d):
    return R.reduce_cells(objects(spark, d), ["label"], op="max").withColumn("value", r("value"))


@query(f"""select label, pos, round(product(x) * 1e6, 4) as value from
    (select *, dense_rank() over (partition by label order by vec_id) as rn from {CELLS}) where rn <= 3 group by all""")
def reduce_prod(spark, d):
    first = R.first_k(vecs(spark, d), members(spark, d), 3, ["object_id"]).where("used")
    return R.reduce_cells(first, ["reduction_id"], op="prod").select(F.col("reduction_id").alias("label"), "pos", r(F.col("value") * 1e6, 4).alias("value"))


@query(f"""select vec_id as object_id, label, pos, round(sum(x) over (partition by label, pos), 6) as value from {CELLS}""")
def allreduce_sum(spark, d):
    return C.allreduce(objects(spark, d), ["label"]).select("object_id", "label", "pos", r("value").alias("value"))


@query(f"""with m as (select 'label' || label as reduction_id, vec_id from embeddings union select 'mod' || (vec_id % 3), vec_id from embeddings
    union select 'all', vec_id from embeddings)
    select reduction_id, pos, round(sum(x), 5) as value from m join {CELLS} using (vec_id) group by all""")
def multi_reduction_fanout(spark, d):
    o = objects(spark, d)
    m = o.select(F.explode(F.array(F.concat(F.lit("label"), "label"), F.concat(F.lit("mod"), F.col("object_id") % 3), F.lit("all"))).alias("reduction_id"), "object_id")
    joined = R.distinct_members(m.unionAll(m)).join(vecs(spark, d), "object_id")
    return R.reduce_cells(joined, ["reduction_id"]).withColumn("value", r("value", 5))


def firsts(k: int, where: str = "true") -> str:
    return f"(select *, row_number() over (partition by label order by vec_id % 8, vec_id) as rn from embeddings where {where})"


def by_arrival(spark, d, k, failed=None):
    return R.first_k(vecs(spark, d).withColumn("arrival", F.col("object_id") % 8), members(spark, d), k, ["arrival", "object_id"], failed)


@query(f"""select reduction_id, pos, round(sum(x), 6) as value from
    (select label as reduction_id, (unnest(range(len(embedding))))::int as pos, unnest(embedding)::double as x from {firsts(8)} where rn <= 8) group by all""")
def subset_reduce_first_k(spark, d):
    return R.reduce_cells(by_arrival(spark, d, 8).where("used"), ["reduction_id"]).withColumn("value", r("value"))


@query(f"select label as reduction_id, array_to_string(list(vec_id order by vec_id), ',') as contributors from {firsts(8)} where rn <= 8 group by all")
def reduced_objects(spark, d):
    out = R.subset_reduce(vecs(spark, d).withColumn("arrival", F.col("object_id") % 8), members(spark, d), 8, ["arrival", "object_id"])
    return out.select("reduction_id", F.array_join(F.col("contributors").cast("array<string>"), ",").alias("contributors"))


@query(f"select label as reduction_id, vec_id as object_id, rn::bigint as rn from {firsts(8)} where rn > 8")
def backup_objects(spark, d):
    late = R.backups(vecs(spark, d).withColumn("arrival", F.col("object_id") % 8), members(spark, d), 8, ["arrival", "object_id"])
    return late.select("reduction_id", "object_id", "rn")


@query(f"""select label as reduction_id, vec_id as object_id, rn::bigint as rn from {firsts(8, 'vec_id % 8 not in (1, 5)')} where rn <= 8""")
def reduce_excluding_failed(spark, d):
    failed = (F.col("object_id") % 8).isin(1, 5)
    return by_arrival(spark, d, 8, failed).where("used").select("reduction_id", "object_id", F.col("rn").cast("long").alias("rn"))


@query("""select event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first_id, max(event_id) as last_id from
    (select *, row_number() over (partition by event_type order by ts, event_id) as rn from events) where rn <= 500 group by all""")
def first_events(spark, d):
    e = table(spark, d, "events").withColumnsRenamed({"event_id": "object_id"})
    m = e.select(F.col("event_type").alias("reduction_id"), "object_id")
    used = R.first_k(e, m, 500, ["ts", "object_id"]).where("used")
    return used.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"))


# --- collectives


@query("select r_regionkey as rank, n_nationkey as object_id, n_name as payload from nation, region")
def broadcast_objects(spark, d):
    ranks = table(spark, d, "region").select(F.col("r_regionkey").alias("rank"))
    return C.broadcast_objects(table(spark, d, "nation").select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("payload")), ranks)


GATHER = "select label, list(vec_id order by vec_id) as members, list(embedding order by vec_id) as vecs from embeddings group by label"


@query(f"select label, len(vecs)::bigint as n, round(list_sum(vecs[1])::double, 4) as first_sum, round(vecs[-1][1]::double, 6) as last_cell from ({GATHER})")
def gather_ordered(spark, d):
    g = C.gather(objects(spark, d), ["label"], "object_id")
    total = F.aggregate(F.col("vecs")[0], F.lit(0.0), lambda a, x: a + x.cast("double"))
    return g.select("label", F.size("vecs").cast("long").alias("n"), r(total, 4).alias("first_sum"), r(F.element_at(F.element_at("vecs", -1), 1).cast("double")).alias("last_cell"))


@query(f"select label, len(flatten(vecs))::bigint as n, round(flatten(vecs)[65]::double, 6) as cell65 from ({GATHER})")
def gather_concat(spark, d):
    g = C.gather_concat(objects(spark, d), ["label"], "object_id")
    return g.select("label", F.size("vec").cast("long").alias("n"), r(F.try_element_at("vec", F.lit(65)).cast("double")).alias("cell65"))


@query(f"select label, r_regionkey as rank, len(vecs)::bigint as n from ({GATHER}), region")
def allgather(spark, d):
    ranks = table(spark, d, "region").select(F.col("r_regionkey").alias("rank"))
    return C.allgather(objects(spark, d), ["label"], "object_id", ranks).select("label", "rank", F.size("vecs").cast("long").alias("n"))


@query("select doc_id, sha256(text) as hash_sent, sha256(text) as hash_back, true as same from documents")
def roundtrip_checksum(spark, d):
    return C.roundtrip(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"""select label, round(sum(case when pos = 1 then x end), 6) as cell1, round(sum(case when pos = 1 then m end), 6) as expected, round(sum(case when pos = 63 then x end) / 63, 6) as last_over_63 from
    (select label, m, pos, m * pos as x from (select label, embedding[1]::double as m, unnest([1, 63]) as pos from embeddings)) group by label""")
def expected_sum_check(spark, d):
    m = F.col("vec")[0].cast("double")
    ramps = objects(spark, d).select("label", m.alias("m"), vectors.ramp(64, m).alias("vec"))
    cells = R.reduce_cells(ramps, ["label"]).groupBy("label").agg(F.max(F.when(F.col("pos") == 1, F.col("value"))).alias("cell1"), F.max(F.when(F.col("pos") == 63, F.col("value") / 63)).alias("last"))
    expected = ramps.groupBy("label").agg(F.sum("m").alias("expected"))
    return cells.join(expected, "label").select("label", r("cell1").alias("cell1"), r("expected").alias("expected"), r("last").alias("last_over_63"))


# --- ids, sizes and hashes


@query("select event_id, lpad(event_id::varchar, 40, '0') as hex, 20::int as bytes, false as nil from events")
def object_id_from_int(spark, d):
    e = table(spark, d, "events").select("event_id", ids.id_from_int(F.col("event_id")).alias("i"))
    return e.select("event_id", ids.id_hex(F.col("i")).alias("hex"), F.octet_length("i").alias("bytes"), ids.is_nil(F.col("i")).alias("nil"))


@query("select vec_id, lower(sha256(vec_id::varchar))[1:40] as hex from embeddings")
def id_hex_codec(spark, d):
    text = F.substring(F.sha2(F.col("vec_id").cast("string").cast("binary"), 256), 1, 40)
    return table(spark, d, "embeddings").select("vec_id", ids.id_hex(ids.id_from_hex(text)).alias("hex"))


@query("""select case when octet_length(encode(text)) <= 65536 then 'inband' else 'streaming' end as size_class, count(*) as n, sum(octet_length(encode(text)))::bigint as bytes from documents group by 1""")
def object_size_class(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy(O.size_class(size).alias("size_class")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


@query("select label, count(*) as n, sum(len(embedding) * 4)::bigint as bytes from embeddings group by label")
def model_bytes(spark, d):
    return objects(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(vectors.byte_size(F.col("vec"))).alias("bytes"))


def wrapped(x: str) -> str:
    """x times the hash's multiplier, modulo 2^64."""
    return f"(({x}) * {MULTIPLIER}::uhugeint) % 18446744073709551616::uhugeint"


def mixed(x: str) -> str:
    return f"xor({x}, {x} >> {SHIFT})"


def little_endian(first: str, n: int = 8) -> str:
    """The number in n bytes of the hexadecimal text x, from byte first (0-based)."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({first} + {i}) + 1, 2)" for i in reversed(range(n))) + ")::uhugeint"


HASHED = f"""(with b as (select doc_id, hex(encode(text)) as x, octet_length(encode(text)) as n from documents),
    w as (select *, list_transform(range(n // 8), lambda i: {wrapped(little_endian('8 * i'))}) as k, case when n % 8 > 0 then {little_endian('n // 8 * 8')} end as tail from b),
    h as (select doc_id, tail, list_reduce(list_prepend({wrapped('n::uhugeint')}, list_transform(k, lambda v: {wrapped(mixed('v'))})), lambda a, v: {wrapped('xor(a, v)')}) as h from w),
    t as (select doc_id, case when tail is null then h else {wrapped('xor(h, tail)')} end as h from h),
    m as (select doc_id, {wrapped(mixed('h'))} as h from t), u as (select doc_id, {mixed('h')} as h from m)
    select doc_id, (h::hugeint - case when h >= 9223372036854775808::uhugeint then 18446744073709551616::hugeint else 0 end)::bigint as hash from u)"""


@query(f"select doc_id, hash from {HASHED}")
def buffer_hash64_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", buffer_hash64(F.col("text").cast("binary")).alias("hash"))


@query(f"select ((sum(hash::hugeint) % 4294967296 + 4294967296) % 4294967296)::bigint as checksum from {HASHED}")
def gather_checksum(spark, d):
    h = table(spark, d, "documents").select(buffer_hash64(F.col("text").cast("binary")).alias("hash"))
    return C.wrapping_checksum(h, "hash")


@query("select vec_id as object_id, 256 as n_bytes from embeddings where vec_id % 2 = 0")
def object_exists(spark, d):
    wanted = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("object_id"))
    return O.exists(vecs(spark, d), wanted).withColumn("n_bytes", F.col("n_bytes").cast("int"))


@query("select case when vec_id % 8 = 2 then 'local' else 'remote' end as place, count(*) as n from embeddings group by 1")
def local_remote_split(spark, d):
    held = vecs(spark, d).withColumn("owner", (F.col("object_id") % 8).cast("string"))
    local, remote = O.split_by_owner(held, members(spark, d), "2")
    return local.withColumn("place", F.lit("local")).unionByName(remote.withColumn("place", F.lit("remote"))).groupBy("place").agg(F.count("*").alias("n"))


@query("select user_id as object_id, arg_max(event_id, event_id) as event_id from events where user_id % 10 <> 3 group by user_id")
def store_upsert_delete(spark, d):
    writes = table(spark, d, "events").select(F.col("user_id").alias("object_id"), "event_id", F.col("event_id").alias("arrival_seq"))
    gone = writes.where("object_id % 10 = 3").select("object_id").distinct()
    return O.delete(O.latest(writes), gone).select("object_id", "event_id")


# --- logs and benchmark statistics


@query("select event_id, case when event_id % 7 <> 0 then event_id / 8.0 end::double as seconds, case when event_id % 7 <> 0 then (user_id % 4)::int end as rank from events")
def log_extract_duration(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit(" "), F.col("user_id") % 4, F.lit(" step time: "), F.col("event_id") / 8, F.lit(" duration = "), F.col("event_id") / 8)
    line = e.select("event_id", F.when(F.col("event_id") % 7 != 0, body).otherwise("warming up").alias("line"))
    return line.select("event_id", logs.duration(F.col("line")).alias("seconds"), logs.ranked_step(F.col("line"))["rank"].alias("rank"))


@query("select event_id, 'allreduce' as test, (4 * (1 + user_id % 4))::int as nodes, (1024 << ((event_id % 3) * 5))::bigint as size, 1000.0 * event_id as p50 from events")
def log_folder_parts(spark, d):
    nodes, size = 4 * (1 + F.col("user_id") % 4), F.expr("shiftleft(1024L, cast((event_id % 3) * 5 as int))")
    e = table(spark, d, "events").select("event_id", F.concat_ws("-", F.lit("20210101"), F.lit("0900"), F.lit("allreduce"), nodes, size).alias("f"), F.concat(F.lit("  8  7 "), F.col("event_id") * 1000, F.lit(" 9")).alias("line"))
    p = e.select("event_id", logs.folder_parts(F.col("f")).alias("p"), logs.token(F.col("line"), 2).cast("decimal(20,1)").alias("p50"))
    return p.select("event_id", "p.test", "p.nodes", "p.size", "p50")


@query("""with e as (select user_id % 50 as folder, event_id, value, row_number() over (partition by user_id % 50 order by event_id) as i from events),
    m as (select folder, (i - 1) % 4 as rank, value, row_number() over (partition by folder, (i - 1) % 4 order by event_id) as n from e),
    c as (select folder from (select folder, rank, count(*) as c from m group by all) group by folder having min(c) = max(c))
    select folder, n::int as n, round(max(value), 6) as slowest from m where folder in (select folder from c) group by all""")
def log_trial_max_over_ranks(spark, d):
    """A folder's events are dealt to four ranks in turn, so that about a quarter of the folders have as many for each."""
    e = table(spark, d, "events").withColumn("folder", F.col("user_id") % 50)
    dealt = B.ordinal(e, ["folder"], ["event_id"]).select("folder", "event_id", "value", ((F.col("n") - 1) % 4).alias("rank"))
    return B.slowest_by_trial(dealt, ["folder"], "rank", ["event_id"], "value").select("folder", F.col("n").cast("int").alias("n"), r("slowest").alias("slowest"))


@query(f"""with m as (select *, row_number() over (partition by test, rank order by event_id) as n from {MEASURED} where seconds > 0),
    s as (select test, min(c) as c from (select test, rank, count(*) as c from m group by all) group by test),
    t as (select m.test, n, max(seconds) as slowest from m join s on m.test = s.test and n <= c and n > 5 group by all)
    select test, round(avg(1 / slowest), 6) as mean, round(stddev_pop(1 / slowest), 6) as std, count(*) as repeats from t group by test""")
def slowest_rank_throughput(spark, d):
    t = B.truncated_slowest(measured(spark, d).where("seconds > 0"), ["test"], "rank", ["event_id"], "seconds", 5)
    return rounded(B.summary(t.withColumn("rate", 1 / F.col("slowest")), ["test"], "rate"))


def rounded(s: DataFrame) -> DataFrame:
    return s.withColumns({c: r(c) for c in ("mean", "std") if c in s.columns})


@query(f"select test, rank, round(avg(seconds), 6) as mean, round(stddev_pop(seconds), 6) as std, count(seconds) as repeats from {MEASURED} group by all")
def bench_mean_std_pop(spark, d):
    return rounded(B.summary(measured(spark, d), ["test", "rank"], "seconds"))


@query(f"select test, rank, round(avg(seconds), 6) as mean, round(stddev_samp(seconds), 6) as std, count(seconds) as repeats from {MEASURED} group by all order by all")
def bench_mean_std_samp(spark, d):
    return rounded(B.summary(measured(spark, d), ["test", "rank"], "seconds", sample=True)).orderBy("test", "rank")


@query("""select g, sum(case when bad then 0 else c end)::bigint as repeats, case when not bad then round(sum(s) / sum(c), 6) end as mean from
    (select *, min(c) over (partition by g) = 0 as bad from (select user_id % 50 as g, user_id, count(v) as c, sum(v) as s from
      (select *, case when event_type = 'click' then value end as v from events) group by all)) group by g, bad""")
def bad_group_policy(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("g"), "user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return B.whole_groups(e, ["g"], "user_id", "v").select("g", F.col("repeats").cast("long").alias("repeats"), r("mean").alias("mean"))


@query(f"select test, rank, arg_max(seconds, event_id) as last from {MEASURED} where seconds is not null group by all")
def last_value_per_file(spark, d):
    return B.last_value(measured(spark, d).where("seconds is not null"), ["test", "rank"], "event_id", "seconds")


NUMBERED = f"(select *, row_number() over (partition by test, rank order by ts, event_id) as n, count(*) over (partition by test, rank) as total from {MEASURED})"


@query(f"select test, rank, round(avg(128 / (1 + seconds)), 6) as mean, count(*) as n from {NUMBERED} where n > 5 group by all")
def throughput_drop_warmup(spark, d):
    m = B.drop_warmup(measured(spark, d), ["test", "rank"], ["ts", "event_id"], 5)
    return m.groupBy("test", "rank").agg(r(F.avg(128 / (1 + F.col("seconds")))).alias("mean"), F.count("*").alias("n"))


@query(f"select test, rank, (n - 1) // 4 as w, round(avg(event_id), 6) as mean, count(*) as rows from {NUMBERED} group by all")
def tumbling4(spark, d):
    return rounded(B.tumbling(measured(spark, d), ["test", "rank"], ["ts", "event_id"], 4, "event_id"))


@query(f"select test, rank, (n - 1) // 2 as w, round(avg(event_id), 6) as mean from {NUMBERED} where n <= total - total % 2 group by all")
def pairwise_mean(spark, d):
    m = B.trim_ends(measured(spark, d), ["test", "rank"], ["ts", "event_id"], 0, 0).where("n <= total - total % 2").drop("n", "total")
    return rounded(B.pairwise_mean(m, ["test", "rank"], ["ts", "event_id"], "event_id"))


@query(f"select test, rank, event_id, n::int as n from {NUMBERED} where n > 4 and n <= total - 3")
def trim_ends(spark, d):
    return B.trim_ends(measured(spark, d), ["test", "rank"], ["ts", "event_id"], 4, 3).select("test", "rank", "event_id", F.col("n").cast("int").alias("n"))


@query("""select event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as took_us from events""")
def step_durations(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return B.step_durations(e, ["user_id"], ["ts", "event_id"], "us").select("event_id", "user_id", F.col("took").alias("took_us"))


@query("select user_id % 10 as g, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as repeats from events where event_type = 'error' group by 1")
def fail_latency(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'").withColumn("g", F.col("user_id") % 10)
    return rounded(B.summary(failed, ["g"], "value"))


@query("select event_type, round(avg(1 / (1 + abs(value))), 6) as mean, round(stddev_pop(1 / (1 + abs(value))), 6) as std, count(value) as repeats from events group by 1")
def rate_mean_of_inverse(spark, d):
    e = table(spark, d, "events").withColumn("rate", 1 / (1 + F.abs("value")))
    return rounded(B.summary(e, ["event_type"], "rate"))


@query("select event_type, round(100.0 * avg(((value > 50)::int = (event_id % 2)::int)::int), 6) as accuracy from events group by 1")
def prediction_accuracy(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") > 50).cast("int").alias("p"), (F.col("event_id") % 2).cast("int").alias("l"))
    return B.accuracy(e.groupBy("event_type"), "p", "l").withColumn("accuracy", r("accuracy"))


GRID = dict(test=["allreduce", "gather", "multicast", "reduce"], nodes=[4, 8, 12, 16], size=[2**10, 2**15, 2**20, 2**25, 2**30])
GRID_SQL = "(select * from (select unnest(['allreduce','gather','multicast','reduce']) as test), (select unnest([4,8,12,16]) as nodes), (select unnest([1024,32768,1048576,33554432,1073741824]) as size))"


@query(f"select test, nodes::bigint as nodes, size::bigint as size from {GRID_SQL}")
def benchmark_grid(spark, d):
    return V.grid(spark, **GRID)


@query(f"""select test, nodes::bigint as nodes, size::bigint as size from {GRID_SQL} g where not exists (select 1 from
    (select distinct 'log-' || ['reduce','gather','none'][1 + user_id % 3] || '-' || (4 * (1 + user_id % 3)) || '-' || (1024 << ((user_id % 2) * 5)) || '-x' as name from events)
    where contains(name, g.test || '-' || g.nodes || '-' || g.size))""")
def coverage_missing(spark, d):
    u = F.col("user_id")
    test = F.element_at(F.array(*map(F.lit, ["reduce", "gather", "none"])), (1 + u % 3).cast("int"))
    names = table(spark, d, "events").select(F.concat_ws("-", F.lit("log"), test, 4 * (1 + u % 3), F.expr("shiftleft(1024L, cast((user_id % 2) * 5 as int))"), F.lit("x")).alias("name"))
    cells = V.grid(spark, **GRID).withColumn("key", F.concat_ws("-", "test", "nodes", "size"))
    return V.missing(cells, names, "key", "name").drop("key")


ORDER = ["signup", "view", "click", "purchase"]


@query("""select event_type, count(*) as n, nullif(list_position(['signup','view','click','purchase'], event_type), 0)::bigint as place from events group by event_type""")
def categorical_order(spark, d):
    return B.ranked(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", ORDER).withColumn("place", F.col("place").cast("long"))


@query("select s_name, row_number() over (order by s_name desc) as place from supplier")
def string_desc_order(spark, d):
    return B.numbered(table(spark, d, "supplier").select("s_name"), [F.desc("s_name")]).select("s_name", F.col("place").cast("long").alias("place"))


@query("""select event_type as method, round(avg(value), 6) as mean from events group by 1 union all select 'optimal', 0.001731493794326 union all select 'floor', 0.0""")
def union_results_with_literals(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(r(F.avg("value")).alias("mean"))
    return e.unionByName(spark.createDataFrame([("optimal", 0.001731493794326), ("floor", 0.0)], "method string, mean double"))


@query("select event_type, count(distinct user_id) as users, min(user_id) filter (user_id <> 3) as smallest_other from events group by 1")
def id_set_remove(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.collect_set("user_id").alias("s"))
    return s.select("event_type", F.size("s").cast("long").alias("users"), F.array_min(F.array_remove("s", 3)).alias("smallest_other"))


@query("""select event_type, event_id, props from events where contains(event_type, 'c') and event_id in (1, 32, 1024)""")
def string_and_in_filter(spark, d):
    e = table(spark, d, "events").where(F.contains("event_type", F.lit("c")) & F.col("event_id").cast("long").isin(1, 32, 1024))
    return e.select("event_type", "event_id", "props")


# --- training and ensembles


@query("select label, vec_id as ord, coalesce(sum(len(embedding)) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from embeddings")
def tensor_offsets(spark, d):
    return T.tensor_offsets(objects(spark, d), ["label"], "object_id", "vec").select("label", F.col("object_id").alias("ord"), "start")


@query("select label, vec_id as ord, round(list_sum(embedding)::double, 3) as total, len(embedding)::int as length from embeddings")
def pack_unpack(spark, d):
    back = T.unpack(T.pack(objects(spark, d), ["label"], "object_id", "vec"), ["label"])
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("label", "ord", r(total, 3).alias("total"), F.size("vec").alias("length"))


@query(f"select label, pos, round(1.0 - 0.01 * sum(x), 6) as w from {CELLS} group by all")
def sgd_step(spark, d):
    g = R.assemble(R.reduce_cells(objects(spark, d), ["label"]), ["label"], "g")
    w = g.select("label", vectors.sgd_step(vectors.fill(F.lit(1.0), F.size("g")), F.col("g"), 0.01).alias("w"))
    return w.select("label", F.posexplode("w").alias("pos", "w")).withColumn("w", r("w"))


def linear_models(spark, skip: tuple[int, ...] = ()) -> DataFrame:
    """Eight models of three classes over 64 inputs, a fixed literal table: weight cos(7 model + 3 class + position)."""
    rows = [(m, c, [math.cos(7 * m + 3 * c + i) for i in range(64)]) for m in range(8) if m not in skip for c in range(3)]
    return spark.createDataFrame(rows, "model int, cls int, weights array<double>")


def ensemble_sql(where: str) -> str:
    s = f"select vec_id, cls, sum(x * cos(7 * m + 3 * cls + pos)) as score from {CELLS}, (select unnest(range(8)) as m), (select unnest(range(3))::int as cls) where {where} group by all"
    return f"select vec_id as object_id, arg_max(cls, score) as predicted, round(max(score), 5) as score from ({s}) group by all"


def ensemble(spark, d, skip=()):
    s = T.ensemble_scores(objects(spark, d), linear_models(spark, skip), ["object_id"])
    return T.ensemble_argmax(s, ["object_id"]).join(s.groupBy("object_id").agg(r(F.max("score"), 5).alias("score")), "object_id")


@query(ensemble_sql("true"))
def ensemble_argmax(spark, d):
    return ensemble(spark, d)


@query(ensemble_sql("m not in (2, 5)"))
def ensemble_partial(spark, d):
    return ensemble(spark, d, (2, 5))


# --- topology, traces, streams


PLANS = [(128, 8), (152, 24), (61, 2), (32, 44)]
#: Closed form: slots are the gaps of the tree, in order; tree node p stands before slot p, and the odd one of two neighbours is a leaf.
TREE = """with d as (select *, greatest(0, least(ceil(log2((objects + 1) / (longest + 1))), floor(log2(objects + 1))))::int as depth from {plans}),
    g as (select *, (1 << depth) as gaps, (objects - (1 << depth) + 1) // (1 << depth) as short, (objects - (1 << depth) + 1) % (1 << depth) as extra from d),
    s as (select *, unnest(range(gaps)) as p from g),
    t as (select objects, longest, gaps, p, p * short + least(p, extra) + p - 1 as ord, short + (p < extra)::int as chain from s),
    tree as (select *, p & -p as step from t where p > 0),
    up as (select *, case when 2 * step < gaps then case when p & (2 * step) > 0 then p - step else p + step end end as above from tree),
    link as (select objects, longest, ord, chain, p + (p + 1) % 2 as leaf, unnest(range(chain)) as i from t)
    select u.objects::int as objects, u.longest::int as longest, u.ord::int as ord, a.ord::int as parent, true as is_tree from up u left join tree a on a.objects = u.objects and a.longest = u.longest and a.p = u.above
    union all
    select l.objects::int, l.longest::int, (l.ord + 1 + i)::int, case when i + 1 < l.chain then l.ord + 2 + i else a.ord end::int, false from link l left join tree a on a.objects = l.objects and a.longest = l.longest and a.p = l.leaf"""


@query(TREE.format(plans=f"(values {', '.join(map(str, PLANS))}) v(objects, longest)"))
def topology_tree(spark, d):
    rows = [(n, k, x.order, x.parent, x.is_tree) for n, k in PLANS for x in topology.plan(n, k).nodes]
    return spark.createDataFrame(rows, "objects int, longest int, ord int, parent int, is_tree boolean")


@query(TREE.format(plans="(select distinct count(*) as objects, 3 + user_id % 7 as longest from events group by user_id)"))
def topology_of_reductions(spark, d):
    """Trees of as many nodes as users have events, with chains of several lengths, by a table function."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("objects"))
    nodes = topology.plans(e.select("objects", (3 + F.col("user_id") % 7).alias("longest")).distinct())
    return nodes.select(F.col("objects").cast("int").alias("objects"), F.col("longest").cast("int").alias("longest"), "ord", "parent", "is_tree")


@query("select doc_id, round(octet_length(encode(text)) / (9.68 * 1073741824 / 8 * 0.00075))::bigint as chain from documents")
def topology_chain_length(spark, d):
    return table(spark, d, "documents").select("doc_id", topology.chain_length(F.octet_length("text")).alias("chain"))


@query("""select json_object('name', event_type, 'cat', 'event', 'ph', case when event_id % 2 = 0 then 'B' else 'E' end, 'ts', (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0'),
    'pid', user_id::varchar, 'tid', event_id::varchar, 'args', json_object('message', props))::varchar as event from events""")
def trace_json(spark, d):
    e = table(spark, d, "events")
    phase = F.when(F.col("event_id") % 2 == 0, "BEGIN").otherwise("END")
    return logs.trace_events(e.select(F.col("event_type").alias("name"), phase.alias("phase"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").alias("pid"), F.col("event_id").alias("tid"), F.col("props").alias("message")))


@query(SQL["reduced_objects"])
def streaming_subset_reduce(spark, d):
    """The same rows as reduced_objects, from a stream over the table's files."""
    cols = [F.col("label").cast("string").alias("reduction_id"), F.col("vec_id").alias("object_id"), (F.col("vec_id") % 8).alias("arrival"), F.col("embedding").alias("vec")]
    fired = quota.run_once(spark, f"{d}/embeddings.parque[t]", lambda s: quota.subset_reduce_stream(s.select(*cols), 8), "quota").where("status = 'fired'")
    return fired.select(F.col("reduction_id").cast("int").alias("reduction_id"), F.array_join(F.col("contributors").cast("array<string>"), ",").alias("contributors"))
