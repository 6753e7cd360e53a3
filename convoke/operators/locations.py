"""Where objects are over time: a table of validity from location events, and what held at a given time.

Events are (object, time, owner), owner null where the object is gone. Both operators are scans over ranges of (object, time), so an
object with most events is spread over tasks, and no event is compared with another.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convoke.operators.scan import scan


def validity(events: DataFrame, keys: list[str], time: list[str], owner: str) -> DataFrame:
    """(keys, owner, valid_from, valid_to): an event holds until the next one of its object; the last one's valid_to is null.

    time is one or more columns, of which the first is the time and the others tell events of one time apart. An event that says what holds already goes
    into the one before it. A null owner, where nothing holds, gives no row.
    """
    told = scan(events.select(*keys, *time, F.col(owner).alias("_owner")), keys, time, lasts={"_was": F.struct("_owner")})
    changes = told.where("_was is null or not (_was._owner <=> _owner)")
    changes = scan(changes, keys, time, {"_i": F.lit(1)})
    ends = changes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_i") - 1).alias("_j"), F.col(time[0]).alias("valid_to"))
    met = [changes[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]
    for m in met[1:]:
        met[0] = met[0] & m
    out = changes.join(ends, met[0] & (changes["_i"] == ends["_j"]), "left")
    return out.where("_owner is not null").select(*keys, F.col("_owner").alias(owner), F.col(time[0]).alias("valid_from"), "valid_to")


def as_of(wanted: DataFrame, events: DataFrame, keys: list[str], time: list[str], value: list[str]) -> DataFrame:
    """The columns of wanted, and of the last event of the same keys up to and with its time the value columns, null if there is none.

    Rows of both sides are put together in order of time; an event comes before what is wanted at the same time, and of events of one time the last by the other time
    columns counts. A null time of what is wanted comes before all events.
    """
    columns = wanted.columns
    spot = [F.col(f"`{c}`").alias(f"_{c}") for c in [*keys, *time]]
    both = wanted.select(*spot, F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.lit(None).cast(struct_type(events, value)).alias("_value"))
    told = events.select(*spot, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in value]).alias("_value")).where(F.col(f"_{time[0]}").isNotNull())
    order = [f"_{time[0]}", "_side", *[f"_{c}" for c in time[1:]]]
    found = scan(both.unionByName(told), [f"_{k}" for k in keys], order, lasts={"_last": F.col("_value")}).where("_side = 1")
    return found.select("_row.*", "_last.*")


def struct_type(df: DataFrame, columns: list[str]) -> StructType:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s")).schema["s"].dataType
