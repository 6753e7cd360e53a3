"""20-byte object ids: codecs between integers, hex text and binary, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_BYTES = 20
NIL_HEX = "ff" * ID_BYTES


def id_from_int(n: Column) -> Column:
    """The decimal digits of n, read as hex digits, left-padded to 20 bytes."""
    return F.unhex(F.lpad(n.cast("string"), 2 * ID_BYTES, "0"))


def id_hex(object_id: Column) -> Column:
    return F.lower(F.hex(object_id))


def id_from_hex(text: Column) -> Column:
    """Raises if the text is not the hex form of 20 bytes."""
    raw = F.unhex(text)
    return F.when(F.octet_length(raw) == ID_BYTES, raw).otherwise(
        F.raise_error(F.concat(F.lit("not a 20-byte id: "), F.coalesce(text, F.lit("null"))))
    )


def is_nil(object_id: Column) -> Column:
    return id_hex(object_id) == NIL_HEX


def random_id() -> Column:
    return F.unhex(F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, 2 * ID_BYTES))
