"""Operators over logs, timelines, locations and streams applied to whole test tables, with their SQL."""

from pyspark.sql import functions as F

from convoke.operators import benchstats as B
from convoke.operators import buffers as U
from convoke.operators import coverage as V
from convoke.operators import exact as X
from convoke.operators import locations as L
from convoke.operators import matching
from convoke.operators import objects as O
from convoke.operators import reduce as R
from convoke.operators import training as T
from convoke.plans.catalog import CELLS, GRID, GRID_SQL, objects, query, r
from convoke.plans.workloads import ALL, TASKS, replay_rows, replay_sql
from convoke.sources import logs
from convoke.sources.tables import table
from convoke.sources.workspace import shared_folder
from convoke.streaming import reductions as S

# --- coverage by substring

TESTS = ["allreduce", "gather", "multicast_1", "reduce", "x"]
#: Names whose test ends in another's, and whose size begins with another's.
NAMED = f"""(select distinct 'log-' || ['{"','".join(TESTS)}'][1 + user_id % 5] || '-' || (4 * (1 + user_id % 3)) || '-' || (1024 << ((user_id % 2) * 5)) || case when user_id % 7 = 0 then '0' else '' end || '-x' as name from events)"""


def folder_names(spark, d):
    u = F.col("user_id")
    test = F.element_at(F.array(*map(F.lit, TESTS)), (1 + u % 5).cast("int"))
    size = F.concat(F.expr("shiftleft(1024L, cast((user_id % 2) * 5 as int))"), F.when(u % 7 == 0, "0").otherwise(""))
    return table(spark, d, "events").select(F.concat_ws("-", F.lit("log"), test, 4 * (1 + u % 3), size, F.lit("x")).alias("name"))


@query(f"select test, nodes::bigint as nodes, size::bigint as size from {GRID_SQL} g where not exists (select 1 from {NAMED} where contains(name, g.test || '-' || g.nodes || '-' || g.size))")
def coverage_by_substring(spark, d):
    cells = V.grid(spark, **GRID).withColumn("key", F.concat_ws("-", "test", "nodes", "size"))
    return V.missing(cells, folder_names(spark, d), "key", "name").drop("key")


@query("""with w as (select distinct unnest(string_split(replace(text, chr(10), ' '), ' ')) as word from documents), k as (select n_name as key from nation union select lower(left(n_name, 3)) from nation union select left(word, 2) from w)
    select key, count(*) as words from k join w on contains(word, key) where key <> '' and word <> '' group by key""")
def keys_in_words(spark, d):
    """In how many distinct words of all documents names of nations, their first three letters and the first two of each word occur."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("word")).where("word <> ''")
    n = table(spark, d, "nation")
    keys = n.select(F.col("n_name").alias("key")).union(n.select(F.lower(F.substring("n_name", 1, 3)))).union(words.select(F.substring("word", 1, 2)))
    return matching.containing(words, keys, "word", "key").groupBy("key").agg(F.count("*").alias("words"))


# --- timelines: every user is a thread; of each four of its events the first and last enclose the others

STEPS = "(select *, row_number() over (partition by user_id order by ts, event_id) as n from events)"
SPANS = f"""(with p as (select *, (n - 1) % 4 as q, (n - 1) // 4 as block from {STEPS}),
    s as (select user_id, 1 as level, block, min(event_type) filter (q = 0) as name, min(epoch_us(ts)) filter (q = 0) as b, min(epoch_us(ts)) filter (q = 3) as e from p group by all
    union all select user_id, 2, block, min(event_type) filter (q = 1), min(epoch_us(ts)) filter (q = 1), min(epoch_us(ts)) filter (q = 2) from p group by all)
    select * from s where e is not null)"""


def engine_lines(spark, d):
    """Log lines of the engine's form, four of a user's events to two nested functions, with lines of another kind between."""
    e = B.ordinal(table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], ["ts", "event_id"])
    q = (F.col("n") - 1) % 4
    mark = F.when(q < 2, "[BEGIN]").otherwise("[END]")
    line = F.concat_ws(" ", F.col("us") * 1000, F.concat(F.lit("app:"), "user_id", F.lit(":7")), F.lit("store.cc:12"), F.col("event_type"), F.lit("]: [TIMELINE]"), F.concat(F.lit("["), "event_id", F.lit("]")), mark, F.col("props"))
    other = F.concat_ws(" ", F.col("us") * 1000, F.lit("app:1:7 store.cc:12 f ]: nothing of note"))
    return e.select("event_id", "n", F.explode(F.array(line, other)).alias("line"))


@query(f"select 'app:' || user_id as pid, level::bigint as level, name, b::bigint as \"begin\", (e - b)::bigint as took from {SPANS}")
def timeline_spans(spark, d):
    """Nested spans of every user's log lines, in microseconds."""
    lines = logs.timeline(engine_lines(spark, d))
    s = logs.spans(lines, ["pid", "tid"], ["ns", "n"])
    return s.select("pid", F.col("level").cast("long").alias("level"), F.regexp_extract("name", r"^(.*)_\[", 1).alias("name"), F.expr("`begin` div 1000").alias("begin"), F.expr("took div 1000").alias("took"))


@query("""select event_type || '_[' || event_id || ']' as name, case when (n - 1) % 4 < 2 then 'B' else 'E' end as ph, (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') as ts, 'app:' || user_id as pid,
    regexp_replace(props, '\\s+', ' ', 'g') as message from """ + STEPS)
def trace_of_logs(spark, d):
    """The trace viewer's document of all log lines, written by many tasks as one document and read again."""
    path = shared_folder(spark, "trace")
    logs.write_trace(logs.timeline(engine_lines(spark, d)), f"{path}/trace", "log/latest")
    return logs.read_document(spark, f"{path}/trace", logs.TRACE_EVENT).select("name", "ph", "ts", "pid", F.col("args.message").alias("message"))


# --- log folders: large files in blocks, new folders only, step times, numbered series


def folder_lines(spark, d, where: str = "true"):
    """A folder for each 24th of the users, a file a rank, a line an event: step times by rank."""
    k = F.col("k")
    e = B.ordinal(table(spark, d, "events").select("event_id", "value", (F.col("user_id") % 24).alias("k")), ["k"], ["event_id"]).where(where)
    test, rank = F.element_at(F.array(*map(F.lit, TASKS)), (1 + k % 6).cast("int")), (F.col("n") - 1) % 4
    step = F.concat(F.lit("x "), rank, F.when(F.col("n") % 2 == 0, " in actor time ").otherwise(" step time: "), F.col("event_id") / 8)
    return e.select(F.concat_ws("-", F.lit("20210101"), F.lit("0900"), test, 4 + k, 1024 + k).alias("folder"), F.concat(F.lit("rank_"), rank, F.lit(".log")).alias("file"), F.col("n").alias("line_no"), step.alias("line"))


RANKED = "(select user_id % 24 as k, event_id, row_number() over (partition by user_id % 24 order by event_id) as i from events)"


@query(f"""select k % 6 as test, (i - 1) % 4 as rank, case when i % 2 = 0 then 'actor' else 'step' end as kind, count(*) as n, round(max(event_id / 8.0), 6)::double as slowest, round(avg(event_id / 8.0), 6)::double as mean from {RANKED} group by all""")
def step_times(spark, d):
    """Step times of two markers, with the rank that the line names, of all files of all folders."""
    path = shared_folder(spark, "steps")
    logs.write_logs(folder_lines(spark, d), path)
    lines = logs.log_lines(spark, f"{path}/*/*").withColumn("k", logs.folder_parts(F.col("folder"))["nodes"] - 4)
    step, actor = logs.ranked_step(F.col("line")), logs.ranked_step(F.col("line"), "in actor time")
    rows = lines.select((F.col("k") % 6).cast("long").alias("test"), F.coalesce(step["rank"], actor["rank"]).cast("long").alias("rank"), F.when(step["rank"].isNull(), "actor").otherwise("step").alias("kind"), F.coalesce(logs.duration(F.col("line"), "step time:"), logs.duration(F.col("line"), "in actor time")).alias("seconds"))
    return rows.groupBy("test", "rank", "kind").agg(F.count("*").alias("n"), r(F.max("seconds")).alias("slowest"), r(F.avg("seconds")).alias("mean"))


@query(f"select k, ((i - 1) // 4)::int as line_no, (i - 1) % 4 as rank, event_id / 8.0::double as seconds, case when k % 2 = 0 then 0 else 1 end::bigint as run from {RANKED}")
def logs_read_once(spark, d):
    """Half of the folders are there at first, the others come later; the second run reads only these, and line numbers are those of the files."""
    path = shared_folder(spark, "incremental")
    for half in (0, 1):
        logs.write_logs(folder_lines(spark, d, f"k % 2 = {half}"), f"{path}/logs")
        read = logs.ingest(spark, f"{path}/logs/*/*", f"{path}/table", f"{path}/state")
    p = logs.folder_parts(F.col("folder"))
    return read.select((p["nodes"] - 4).cast("long").alias("k"), "line_no", F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("rank"), F.regexp_extract("line", r"([0-9.]+)$", 1).cast("double").alias("seconds"), F.col("batch").alias("run"))


@query("""select event_type as algorithm, (user_id % 4)::int as world_size, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as repeats from events group by all""")
def numbered_csv_series(spark, d):
    """Three files without a header, numbered from 1, hold a third of the measurements each; what comes after a gap isn't read."""
    path = shared_folder(spark, "series")
    e = table(spark, d, "events").select(F.col("event_type").alias("algorithm"), (F.col("user_id") % 4).cast("int").alias("world_size"), F.lit(1024).cast("long").alias("object_size"), F.col("value").alias("duration"), (1 + F.col("event_id") % 3).alias("i"))
    for i in (1, 2, 3, 5):
        logs.write_csv(e.where(F.col("i") == (i if i < 5 else 1)).drop("i"), f"{path}/result-{i}.csv", False)
    there = lambda p: logs.exists(spark, p)
    s = logs.numbered_series(spark, f"{path}/result-%d.csv", there)
    return s.groupBy("algorithm", "world_size").agg(r(F.avg("duration")).alias("mean"), r(F.stddev_samp("duration")).alias("std"), F.count("duration").alias("repeats"))


# --- locations: purchases and views write where an object is, errors say that it is gone, clicks and signups ask

HELD = "(select user_id % 40 as object_id, ts, event_id, case when event_type <> 'error' then event_id % 8 end as owner from events where event_type in ('purchase', 'view', 'error'))"


def held(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'view', 'error')")
    return e.select((F.col("user_id") % 40).alias("object_id"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_id") % 8).alias("owner"))


@query(f"""with q as (select event_id, user_id % 40 as object_id, ts from events where event_type in ('click', 'signup')), w as (select object_id, ts, arg_max(owner is not null, event_id) as there, arg_max(coalesce(owner, -1), event_id) as owner from {HELD} group by all)
    select q.event_id, q.object_id, case when w.there then w.owner end as owner from q asof left join w on q.object_id = w.object_id and q.ts >= w.ts""")
def held_at(spark, d):
    """Who held the object when each click or signup asked."""
    asked = table(spark, d, "events").where("event_type in ('click', 'signup')").select("event_id", (F.col("user_id") % 40).alias("object_id"), "ts")
    found = L.as_of(asked, held(spark, d), ["object_id"], ["ts", "event_id"], ["owner"])
    return found.select("event_id", "object_id", "owner")


@query(f"""with c as (select * from {HELD} window w as (partition by object_id order by ts, event_id) qualify row_number() over w = 1 or lag(owner) over w is distinct from owner)
    select object_id, owner, epoch_us(ts) as valid_from, epoch_us(lead(ts) over (partition by object_id order by ts, event_id)) as valid_to from c qualify owner is not null""")
def location_validity(spark, d):
    v = L.validity(held(spark, d), ["object_id"], ["ts", "event_id"], "owner")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return v.select("object_id", "owner", us("valid_from"), us("valid_to"))


# --- buffers in blocks and exact sums

WIDTH = 100
PLACED = f"(select label, x, pos + coalesce(sum(len) over (partition by label order by vec_id range between unbounded preceding and 1 preceding), 0)::bigint as spot from (select vec_id, label, embedding[i + 1]::double as x, i as pos, case when i = 0 then len(embedding) else 0 end as len from embeddings, (select unnest(range(64)) as i)))"


@query(f"select label, (spot // {WIDTH})::bigint as block, count(*) as n, round(sum(x), 5) as total, round(arg_min(x, spot), 6) as first from {PLACED} group by all")
def gather_in_blocks(spark, d):
    """Each label's embeddings as one buffer, in blocks of 100 elements."""
    b = U.blocked(objects(spark, d), ["label"], "object_id", block=WIDTH)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return b.select("label", "block", F.size("data").cast("long").alias("n"), r(total, 5).alias("total"), r(F.col("data")[0].cast("double")).alias("first"))


@query(f"select v.vec_id as object_id, count(*) as n, round(sum(x), 5) as total from embeddings v join {PLACED} p on p.label = v.label and p.spot >= v.vec_id * 7 and p.spot < v.vec_id * 7 + 130 group by v.vec_id")
def read_in_blocks(spark, d):
    """130 elements of its label's buffer for every embedding, from an offset of its own; some lie beyond the end."""
    o = objects(spark, d)
    wanted = o.select("object_id", "label", (F.col("object_id") * 7).alias("first"), F.lit(130).cast("long").alias("n"))
    got = U.read(U.blocked(o, ["label"], "object_id", block=WIDTH), wanted, ["label"], WIDTH)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.groupBy("object_id").agg(F.sum(F.size("data").cast("long")).alias("n"), r(F.sum(total), 5).alias("total"))


@query(f"select label, pos, round(sum(x), 6) as value from {CELLS} group by all")
def reduce_sum_exact(spark, d):
    """Sums whose bits don't depend on the order of addition."""
    return R.reduce_cells(objects(spark, d), ["label"], exact=True).withColumn("value", r("value"))


@query("select l_returnflag, l_linestatus, round(sum(l_extendedprice::decimal(18, 2)), 2)::double as price, round(sum(l_tax::decimal(18, 2)), 2)::double as tax from lineitem group by all")
def exact_totals(spark, d):
    li, keys = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    price, tax = (X.exact_sum(li, keys, c, n).withColumn(n, r(n, 2)) for c, n in (("l_extendedprice", "price"), ("l_tax", "tax")))
    return price.join(tax, keys)


# --- streams: several reductions of the same objects, tasks before and after these, failures at any time

QUOTAS = {"label": 8, "mod": 40, "all": 200}


@query("""with m as (select 'label' || label as reduction_id, vec_id, 8 as k from embeddings union select 'mod' || (vec_id % 3), vec_id, 40 from embeddings union select 'all', vec_id, 200 from embeddings),
    u as (select *, row_number() over (partition by reduction_id order by vec_id % 8, vec_id) as rn from m where vec_id % 8 not in (1, 5))
    select reduction_id, vec_id as object_id, (count(*) over (partition by reduction_id)) = k as filled from u where rn <= k""")
def streaming_tasks(spark, d):
    """What each reduction uses after a stream of tasks, arrivals and failures, in an order that has nothing to do with that in which they happened, in several batches and two runs."""
    o = objects(spark, d)
    lists = o.select("object_id", F.explode(F.array(*[F.struct(F.concat(F.lit(n), w).alias("id"), F.lit(q).alias("k")) for (n, q), w in zip(QUOTAS.items(), (F.col("label").cast("string"), (F.col("object_id") % 3).cast("string"), F.lit("")))])).alias("t"))
    members = lists.select(F.lit("member").alias("kind"), F.col("t.id").alias("reduction_id"), "object_id", F.col("t.k").alias("k"), F.lit(0).cast("long").alias("seq"))
    come = S.object_events(o.select("object_id", (F.col("object_id") % 8).alias("seq")), "arrived")
    gone = S.object_events(o.where("object_id % 8 in (1, 5)").select("object_id", (100 + F.col("object_id")).alias("seq")), "failed")
    events, path = members.unionByName(come).unionByName(gone), shared_folder(spark, "tasks")
    for half in (0, 1):
        part = events.where(F.pmod(F.xxhash64("kind", "reduction_id", "object_id"), F.lit(2)) == half)
        part.repartition(4, F.xxhash64("object_id", "kind")).write.mode("append").parquet(f"{path}/events")
        changes = S.run(spark, f"{path}/events", f"{path}/state", files=2)
    return S.contributors(changes)


# --- objects put with random ids and read as buffers, orders, filters, grids of what there is, training without a server


@query("select label, count(*) as n, count(*) as ids, min(20)::int as bytes, round(sum(list_sum(embedding)::double), 3) as total from embeddings group by label")
def put_and_get(spark, d):
    """Every embedding is put under a random id, as a buffer, and got by it."""
    put = O.put_rows(objects(spark, d).select("label", "vec"))
    buffers = O.to_buffers(put)
    got = put.select("object_id", "label").join(O.from_buffers(buffers), "object_id")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("ids"), F.min(F.octet_length("object_id")).alias("bytes"), r(F.sum(total), 3).alias("total"))


@query("""select *, row_number() over (order by name desc, nodes desc, size desc) as place from
    (select event_type as name, (4 * (1 + user_id % 4))::varchar as nodes, (1024 << ((event_id % 4) * 10))::bigint::varchar as size, count(*) as n from events group by all)""")
def text_tuples_descending(spark, d):
    """Results in descending order of name, nodes and size, all as text, so that 8 nodes come before 16."""
    size = F.expr("shiftleft(1024L, cast((event_id % 4) * 10 as int))").cast("string")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), (4 * (1 + F.col("user_id") % 4)).cast("string").alias("nodes"), size.alias("size")).agg(F.count("*").alias("n"))
    return B.numbered(e, [F.desc("name"), F.desc("nodes"), F.desc("size")]).withColumn("place", F.col("place").cast("long"))


@query("""select event_type as test, (1024 << ((event_id % 3) * 10))::bigint as size, round(avg(value), 6) as mean, count(value) as repeats from events where event_type <> 'error' and (1024 << ((event_id % 3) * 10)) <> 1048576 group by all""")
def csv_by_name_and_size(spark, d):
    """A result table as CSV, read again for all names but one and all sizes but one; the filters reach the scan."""
    size = F.expr("shiftleft(1024L, cast((event_id % 3) * 10 as int))")
    s = B.summary(table(spark, d, "events").select(F.col("event_type").alias("test"), size.alias("size"), "value"), ["test", "size"], "value")
    path = shared_folder(spark, "csv")
    logs.write_csv(s, f"{path}/results")
    back = logs.results_csv(spark, f"{path}/results", True, "test string, size long, mean double, std double, repeats long")
    return back.where((F.col("test") != "error") & (F.col("size") != 1 << 20)).select("test", "size", r("mean").alias("mean"), "repeats")


@query("""with t as (select distinct event_type as test from events), n as (select distinct user_id % 16 as nodes from events), s as (select distinct event_id % 40 as size from events)
    select test, nodes, size from t, n, s where not exists (select 1 from events where event_type = test and user_id % 16 = nodes and event_id % 40 = size and value > 50)""")
def grid_of_what_there_is(spark, d):
    """All combinations of the kinds, nodes and sizes that occur, and of these the ones without a measurement above 50."""
    e = table(spark, d, "events").select(F.col("event_type").alias("test"), (F.col("user_id") % 16).alias("nodes"), (F.col("event_id") % 40).alias("size"), "value")
    return V.absent(V.combinations(e, ["test", "nodes", "size"]), e.where("value > 50"), ["test", "nodes", "size"])


@query(f"with t as ({replay_sql(ALL[:2], False)}), o as (select distinct vec_id % 8 as owner from embeddings) select owner, pos, w from t, o")
def allreduce_training(spark, d):
    """Two steps in which every owner applies the mean gradient of all to weights of its own."""
    held = T.allreduce_training(replay_rows(spark, d), 64, T.linear_gradient, 2, 0.01, "owner")
    return held.select("owner", F.posexplode("w").alias("pos", "w")).withColumn("w", r("w"))
