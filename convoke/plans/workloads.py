"""More of the engine's operators applied to whole test tables with their SQL: log folders, arrival in list order, waiters, training replays, small lookups."""

import math

from pyspark.sql import functions as F

from convoke.functions import vectors
from convoke.operators import benchstats as B
from convoke.operators import collect as C
from convoke.operators import objects as O
from convoke.operators import reduce as R
from convoke.operators import training as T
from convoke.plans.catalog import CELLS, MEASURED, measured, members, objects, query, r, vecs
from convoke.sources import logs
from convoke.sources.tables import table
from convoke.sources.workspace import shared_folder
from convoke.streaming import quota

# --- log folders, written from events and read again

TASKS = ["allreduce", "gather", "multicast", "reduce", "subset_reduce", "allgather"]
#: A folder has 1/24 of the users' events; its task, nodes and size follow from its number. Ranks take its events in turn; every seventh line has no measurement.
LOGGED = f"""(select k, ['{"','".join(TASKS)}'][1 + k % 6] as test, 4 + k as nodes, 1024 + k as size, (i - 1) % 4 as rank, i, event_id,
    case when event_id % 7 <> 0 then event_id / 8.0 end as seconds
    from (select user_id % 24 as k, event_id, row_number() over (partition by user_id % 24 order by event_id) as i from events))"""
COUNTED = f"(select * from {LOGGED} where test in ('allreduce', 'allgather') or test = 'multicast' and rank <> 0 or test in ('reduce', 'gather', 'subset_reduce') and rank = 0)"


def log_folder(spark, d) -> str:
    """Events as logs: folders date-time-test-nodes-size with a file a rank."""
    k = F.col("k")
    e = B.ordinal(table(spark, d, "events").select("event_id", (F.col("user_id") % 24).alias("k")), ["k"], ["event_id"])
    test = F.element_at(F.array(*map(F.lit, TASKS)), (1 + k % 6).cast("int"))
    body = F.concat(F.lit("x  y "), F.col("event_id"), F.lit(" duration = "), F.col("event_id") / 8)
    lines = e.select(
        F.concat_ws("-", F.lit("20210101"), F.lit("0900"), test, 4 + k, 1024 + k).alias("folder"), F.concat(F.lit("rank_"), (F.col("n") - 1) % 4, F.lit(".log")).alias("file"), F.col("n").alias("line_no"),
        F.when(F.col("event_id") % 7 != 0, body).otherwise("warming up").alias("line"),
    )
    path = shared_folder(spark, "logs")
    logs.write_logs(lines, path)
    return path


@query(f"""with c as (select k, test, nodes, size, rank, count(seconds) as c from {COUNTED} group by all),
    g as (select k, test, nodes, size, min(c) = max(c) and min(c) > 0 as good from c group by all),
    t as (select k, n, max(seconds) as seconds from (select k, seconds, row_number() over (partition by k, rank order by i) as n from {COUNTED} where seconds is not null) group by all)
    select test, nodes::int as nodes, size::bigint as size, case when good then n::int end as n, case when good then round(seconds, 6)::double end as seconds
    from g left join t using (k) where good or n = 1 or n is null""")
def log_folders_by_task(spark, d):
    """Which ranks' files count depends on the task; a folder with ranks of unequal length is bad."""
    return logs.parsed_folders(spark, log_folder(spark, d)).select("test", "nodes", "size", "n", r("seconds").alias("seconds"))


@query(f"select test, nodes::int as nodes, size::bigint as size, round(avg(seconds), 6)::double as mean, round(stddev_pop(seconds), 6)::double as std, count(seconds) as repeats from {LOGGED} where rank = 0 group by all")
def log_rank0_summary(spark, d):
    """The common parser: measurements of rank 0, by task, nodes and size."""
    lines = logs.log_lines(spark, f"{log_folder(spark, d)}/*/*", rank=0).withColumn("p", logs.folder_parts(F.col("folder")))
    s = B.summary(lines.select("p.*", logs.duration(F.col("line")).alias("seconds")), ["test", "nodes", "size"], "seconds")
    return s.withColumns({c: r(c) for c in ("mean", "std")})


@query(f"select test, nodes::int as nodes, count(*) as lines, count(seconds) as measured from {LOGGED} where rank <> 0 group by all")
def log_all_ranks_but_0(spark, d):
    lines = logs.log_lines(spark, f"{log_folder(spark, d)}/*/*", without_rank=0).where("line <> ''").withColumn("p", logs.folder_parts(F.col("folder")))
    return lines.groupBy("p.test", "p.nodes").agg(F.count("*").alias("lines"), F.count(logs.duration(F.col("line"))).alias("measured"))


@query(f"select nodes::int as nodes, rank::int as rank, round(event_id / 1e6, 9)::double as seconds from {LOGGED} where (i - 1) // 4 = 5 and event_id % 7 <> 0")
def log_fixed_line_token(spark, d):
    """Line 5 of each file, token 2, in microseconds."""
    lines = logs.log_lines(spark, f"{log_folder(spark, d)}/*/*")
    found = logs.line_token(lines, 5, 2, 1e-6, "seconds").where("seconds is not null")
    return found.select(logs.folder_parts(F.col("folder"))["nodes"].alias("nodes"), F.regexp_extract("file", r"rank_(\d+)", 1).cast("int").alias("rank"), r("seconds", 9).alias("seconds"))


@query(f"select test, rank, round(avg(seconds), 6) as mean, round(stddev_samp(seconds), 6) as std, count(seconds) as repeats from {MEASURED} where test = 'click' group by all")
def csv_results(spark, d):
    """A result table as CSV with a header and a series without one, written and read again, filtered by name, some columns of it."""
    s = B.summary(measured(spark, d), ["test", "rank"], "seconds", sample=True)
    path = shared_folder(spark, "csv")
    logs.write_csv(s, f"{path}/headed")
    schema = "test string, rank long, mean double, std double, repeats long"
    logs.write_csv(logs.results_csv(spark, f"{path}/headed", True, schema), f"{path}/plain", False)
    back = logs.results_csv(spark, f"{path}/plain", False, schema).where("test = 'click'")
    return back.select("test", "rank", r("mean").alias("mean"), r("std").alias("std"), "repeats")


@query("select user_id % 10 as id, round(avg(value), 6) as duration, case when max(event_id) % 2 = 0 then 'ok' else 'fail' end as event from events group by 1")
def json_array_events(spark, d):
    """Records written as one JSON array, by many tasks, and read again."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("id")).agg(r(F.avg("value")).alias("duration"), F.when(F.max("event_id") % 2 == 0, "ok").otherwise("fail").alias("event"))
    path = shared_folder(spark, "json")
    logs.write_document(e, f"{path}/events", ["id"])
    return logs.read_document(spark, f"{path}/events", "id long, duration double, event string")


# --- arrival, stores and waiters


@query("""select reduction_id, object_id, rn::int as rn from (select label as reduction_id, vec_id as object_id, row_number() over (partition by label order by
    vec_id % 8 > 3, case when vec_id % 8 <= 3 then (vec_id % 16 = 2)::int end, case when vec_id % 8 <= 3 then -vec_id else vec_id % 8 end, vec_id) as rn from embeddings) where rn <= 12""")
def creation_order(spark, d):
    """Objects there at time 3 count in list order (descending ids), the caller's own small ones last; later ones as they arrive."""
    o = vecs(spark, d).withColumn("arrival", F.col("object_id") % 8)
    m = members(spark, d).withColumn("ord", -F.col("ord"))
    return R.in_creation_order(o, m, F.lit(3), F.col("object_id") % 16 == 2).where("rn <= 12").select("reduction_id", "object_id", "rn")


EVENTS = "(select user_id % 200 as object_id, event_id as seq, case when event_type = 'error' then 'ready' else 'request' end as kind from events)"


@query(f"""with r as (select object_id, min(seq) as ready from {EVENTS} where kind = 'ready' group by all)
    select object_id, seq as request, greatest(seq, ready) as served_at, seq < ready as waited from {EVENTS} join r using (object_id) where kind = 'request'""")
def pending_requests(spark, d):
    """Requests before their object is ready wait for it, in a stream over the table."""
    kind = F.when(F.col("event_type") == "error", "ready").otherwise("request")
    events = lambda s: s.select((F.col("user_id") % 200).alias("object_id"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return quota.run_once(spark, f"{d}/events.parque[t]", lambda s: quota.waiters_stream(events(s)), "waiters")


@query(f"select label as reduction_id, pos, round(sum(x), 6) as value from {CELLS} group by all")
def reduce_in_one_task(spark, d):
    made = R.reduce_local(vecs(spark, d), members(spark, d))
    return made.select("reduction_id", F.posexplode("vec").alias("pos", "value")).withColumn("value", r("value"))


@query("select label as reduction_id, vec_id as object_id, vec_id % 8 as owner from embeddings")
def contributors_to_owners(spark, d):
    found = R.reduce_vectors(vecs(spark, d), members(spark, d)).select("reduction_id", "contributors")
    return R.by_contributor(found, vecs(spark, d).select("object_id", (F.col("object_id") % 8).alias("owner")))


@query("select user_id % 20 as k, event_id as chain, value as length from events qualify row_number() over (partition by user_id % 20 order by value, event_id) = 1")
def shortest_chain(spark, d):
    return R.shortest(table(spark, d, "events").select((F.col("user_id") % 20).alias("k"), F.col("event_id").alias("chain"), F.col("value").alias("length")), ["k"], "length", "chain")


@query("select vec_id as object_id, vec_id % 3 = 0 as reused, round(case when vec_id % 3 = 0 then embedding[1]::double else 1.0 end, 6) as first from embeddings where vec_id % 5 <> 1")
def sealed_and_reused(spark, d):
    """Every third object exists, each fifth of all isn't sealed yet; wanted ones that exist keep what they hold."""
    o = O.sealed(vecs(spark, d).withColumn("sealed", F.col("object_id") % 5 != 1))
    wanted = o.select("object_id", F.array(F.lit(1.0).cast("float")).alias("vec"))
    return O.get_or_create(o.where("object_id % 3 = 0"), wanted).select("object_id", "reused", r(F.col("vec")[0].cast("double")).alias("first"))


@query("select (sum(('0x' || md5(text)[1:8])::bigint) % 4294967296)::bigint as checksum from documents")
def content_checksum(spark, d):
    h = table(spark, d, "documents").select(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    return C.wrapping_checksum(h, "h")


@query("""with wanted as (select vec_id as object_id from embeddings union all select -1 - vec_id from embeddings)
    select object_id, v.vec_id is not null as local, (4 * len(v.embedding))::bigint as n_bytes from wanted left join embeddings v on object_id = v.vec_id""")
def objects_local_or_not(spark, d):
    """Every object is asked for, and as many ids that none has."""
    held = vecs(spark, d)
    wanted = held.select("object_id").unionAll(held.select((-1 - F.col("object_id")).alias("object_id")))
    there = O.exists(held, wanted)
    return wanted.join(there, "object_id", "left").select("object_id", F.col("n_bytes").isNotNull().alias("local"), "n_bytes")


@query("""select event_id, event_type, (1024 << ((user_id % 4) * 10))::bigint as size, value from events where contains(event_type, 'c') and (1024 << ((user_id % 4) * 10)) in (1024, 1048576, 1073741824)""")
def name_and_size_filter(spark, d):
    """Results of one kind and of three of the four sizes; sizes come as text, as from a log, and are cast."""
    size = F.expr("shiftleft(1024L, cast((user_id % 4) * 10 as int))").cast("string").alias("size")
    e = table(spark, d, "events").select("event_id", "event_type", size, "value").withColumn("size", F.col("size").cast("long"))
    return e.where(F.contains("event_type", F.lit("c")) & F.col("size").isin(2**10, 2**20, 2**30))


# --- statistics and small lookups


@query(f"select test, round(avg(m), 6) as mean, count(m) as files from (select test, rank, avg(seconds) as m from {MEASURED} group by all) group by test")
def mean_of_file_means(spark, d):
    return B.mean_of_means(measured(spark, d), ["test"], "rank", "seconds").withColumn("mean", r("mean"))


@query("select round(100 * avg(((value > 50)::int = (event_id % 2)::int)::int), 6) as accuracy from (select * from events order by event_id limit 1152)")
def accuracy_of_first_batches(spark, d):
    """Batches of 128 up to the one before which more than 1024 rows were seen."""
    e = table(spark, d, "events").select("event_id", (F.col("value") > 50).cast("int").alias("p"), (F.col("event_id") % 2).cast("int").alias("l"))
    return B.accuracy_until(e, "event_id", "p", "l", 128, 1024).withColumn("accuracy", r("accuracy"))


SYSTEMS = {"click": "tree", "view": "chain", "purchase": "tree", "signup": "chain", "error": "none"}


@query(f"select event_type, {'case ' + ' '.join(f'''when event_type = '{k}' then '{v}' ''' for k, v in SYSTEMS.items()) + 'end'} as system, count(*) as n from events group by all")
def systems_by_task(spark, d):
    return B.mapped(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", SYSTEMS, "system")


@query("""select s_suppkey, starts_with(s_name, 'Supplier#0') as starts, replace(s_name, '#', '/') as replaced, rpad(s_name, 24, '.') as left_just, lpad(s_name, 24, '.') as right_just,
    array_to_string(list_reverse(string_split(s_name, '#')), '+') as joined from supplier""")
def string_functions(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.startswith(n, F.lit("Supplier#0")).alias("starts"), F.replace(n, F.lit("#"), F.lit("/")).alias("replaced"), F.rpad(n, 24, ".").alias("left_just"), F.lpad(n, 24, ".").alias("right_just"),
        F.array_join(F.reverse(F.split(n, "#")), "+").alias("joined"),
    )


# --- training replays


def step_sql(k: int, held: dict[int, int], where: str) -> str:
    """CTEs of step k: predictions of the weights that each owner holds, their gradient, and the next weights."""
    w = " union all ".join(f"select {o} as owner, pos, w from w{v}" for o, v in held.items())
    return f"""p{k} as (select vec_id, sum(x * w) - label as e from cells join ({w}) using (owner, pos) where {where} group by vec_id, label),
    g{k} as (select pos, sum(e * x) / (select count(*) from p{k}) as g from p{k} join cells using (vec_id) group by pos),
    w{k + 1} as (select pos, w - 0.01 * g as w from w{k} join g{k} using (pos))"""


def replay_sql(ready: list[list[int]], stale: bool, rejoins: dict[int, list[int]] | None = None) -> str:
    held, parts = dict.fromkeys(range(8), 0), []
    for k, now in enumerate(ready):
        held |= dict.fromkeys(rejoins.get(k, []) if rejoins else [], k)
        at = held if stale else dict.fromkeys(held, k)
        parts.append(step_sql(k, {o: at[o] for o in now}, f"owner in ({', '.join(map(str, now))})"))
        held |= dict.fromkeys(now, k + 1)
    return f"""with cells as (select vec_id, vec_id % 8 as owner, label::double as label, pos, x from {CELLS}), w0 as (select unnest(range(64))::int as pos, 0.0::double as w),
    {', '.join(parts)} select pos, round(w, 6) as w from w{len(ready)}"""


def replay_rows(spark, d):
    return objects(spark, d).select((F.col("object_id") % 8).alias("owner"), F.col("vec").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


def weights(spark, w):
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "pos int, w double")


ALL, READY, REJOINS = [list(range(8))] * 3, [[0, 1, 2, 3], [4, 5, 0, 6], [7, 1, 2, 4], [0, 3, 5, 6]], {2: [2]}


@query(replay_sql(ALL, False))
def synchronous_training(spark, d):
    return weights(spark, T.synchronous(replay_rows(spark, d), [0.0] * 64, T.linear_gradient, 3, 0.01, "owner"))


ALIVE = [[0, 1, 2, 3], [4, 5, 6, 7], [0, 1, 3, 4]]


@query(replay_sql(ALIVE, False))
def subset_training(spark, d):
    """Each step uses the next four owners that are alive: owner 2 has failed when its second turn comes."""
    return weights(spark, T.synchronous(replay_rows(spark, d), [0.0] * 64, T.linear_gradient, 3, 0.01, "owner", lambda k: ALIVE[k]))


@query(replay_sql(READY, False))
def training_first_ready(spark, d):
    """Each step takes the newest weights to the four owners that are ready."""
    return weights(spark, T.synchronous(replay_rows(spark, d), [0.0] * 64, T.linear_gradient, 4, 0.01, "owner", lambda k: READY[k]))


@query(replay_sql(READY, True))
def training_stale(spark, d):
    """Owners work with the weights that they were last given."""
    return weights(spark, T.asynchronous(replay_rows(spark, d), [0.0] * 64, T.linear_gradient, 4, 0.01, "owner", lambda k: READY[k])[0])


@query(replay_sql(READY, True, REJOINS))
def training_rejoin(spark, d):
    """Owner 2 fails after the first step, and comes back at the third with the newest weights."""
    return weights(spark, T.asynchronous(replay_rows(spark, d), [0.0] * 64, T.linear_gradient, 4, 0.01, "owner", lambda k: READY[k], lambda k: REJOINS.get(k, []))[0])


@query("""with m as (select distinct event_id % 50 as step, user_id % 8 as model from events), f as (select distinct event_id % 50 as step, user_id % 8 as model from events where event_type = 'error' and value > 60)
    select step, model, case when f then 'fail' when coalesce(lag(f) over (partition by model order by step), false) then 'rejoin' else 'ok' end as event
    from (select m.step, m.model, f.step is not null as f from m left join f using (step, model))""")
def serving_events(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 50).alias("step"), (F.col("user_id") % 8).alias("model"), "event_type", "value")
    return T.serving_events(e.select("step", "model").distinct(), e.where("event_type = 'error' and value > 60").select("step", "model").distinct())


@query(f"""select label, pos // 4 as i, round(sum(m), 5) as pooled from (select label, vec_id, pos // 4 * 4 as pos, max(greatest(x, 0)) as m from {CELLS} group by label, vec_id, pos // 4) group by all""")
def relu_and_pool(spark, d):
    pooled = objects(spark, d).select("label", F.posexplode(vectors.max_pool(vectors.relu(F.col("vec").cast("array<double>")), 4)).alias("i", "m"))
    return pooled.groupBy("label", F.col("i").cast("long").alias("i")).agg(r(F.sum("m"), 5).alias("pooled"))


@query(f"""with s as (select vec_id, cls, sum(x * cos(3 * cls + pos)) as z from {CELLS}, (select unnest(range(3))::int as cls) group by all)
    select vec_id as object_id, cls, round(z - (max(z) over (partition by vec_id)) - ln(sum(exp(z - m)) over (partition by vec_id)), 6) as logp
    from (select *, max(z) over (partition by vec_id) as m from s)""")
def matmul_log_softmax(spark, d):
    rows = F.array(*[F.array(*[F.lit(math.cos(3 * c + i)) for i in range(64)]) for c in range(3)])
    z = vectors.log_softmax(vectors.matmul(rows, F.col("vec").cast("array<double>")))
    return vecs(spark, d).select("object_id", F.posexplode(z).alias("cls", "z")).select("object_id", "cls", r("z").alias("logp"))


@query(f"""select label, (pos // 16)::int as tensor, (pos % 16)::int as pos, round(case when pos // 16 = 2 then 1.0 else 1.0 - 0.01 * sum(x) end, 6) as w from {CELLS} group by label, pos""")
def sgd_skips_null_gradients(spark, d):
    """Four tensors of 16, of which the third has no gradient."""
    g = R.assemble(R.reduce_cells(objects(spark, d), ["label"]), ["label"], "g")
    parts = F.array(*[F.when(F.lit(k != 2), F.slice("g", 16 * k + 1, 16)) for k in range(4)])
    ones = F.array_repeat(F.array_repeat(F.lit(1.0), 16), 4)
    w = g.select("label", F.posexplode(vectors.sgd_steps(ones, parts, 0.01)).alias("tensor", "v"))
    return w.select("label", "tensor", F.posexplode("v").alias("pos", "w")).withColumn("w", r("w"))
