"""Rows as one compressed binary value, of a few dozen bytes beside the rows' own: small blobs, of which a shuffle may have many, stay small."""

import struct

import numpy as np
import pyarrow as pa

#: The kind of a column of binaries; others have numpy's.
BINARY = b"bin"


def pack(table: pa.Table) -> bytes:
    """Columns without nulls, of numbers, booleans or binaries."""
    parts = [struct.pack("<qB", table.num_rows, table.num_columns)]
    for name, column in zip(table.column_names, table.columns, strict=True):
        array = column.combine_chunks()
        if pa.types.is_large_binary(array.type) or pa.types.is_binary(array.type):
            array = array.cast(pa.large_binary())
            edge = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset) if len(array) else np.zeros(1, np.int64)
            kind, data = BINARY, [np.diff(edge).astype("<u4").tobytes(), memoryview(array.buffers()[2] or b"")[edge[0] : edge[-1]]]
        else:
            values = array.to_numpy(zero_copy_only=False)
            kind, data = values.dtype.str[-2:].encode(), [values.tobytes()]
        parts += [struct.pack("<BB", len(name.encode()), len(kind)), name.encode(), kind, *data]
    raw = b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> pa.Table:
    raw = pa.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], codec="zstd", asbytes=True)
    (n, width), at, columns = struct.unpack_from("<qB", raw), 9, {}
    for _ in range(width):
        a, b = struct.unpack_from("<BB", raw, at)
        name, kind, at = raw[at + 2 : at + 2 + a].decode(), raw[at + 2 + a : at + 2 + a + b], at + 2 + a + b
        if kind == BINARY:
            edge = np.zeros(n + 1, np.int64)
            np.cumsum(np.frombuffer(raw, "<u4", n, at), out=edge[1:])
            at += 4 * n
            columns[name] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edge), pa.py_buffer(memoryview(raw)[at : at + int(edge[-1])])])
            at += int(edge[-1])
        else:
            columns[name] = pa.array(np.frombuffer(raw, np.dtype(kind.decode()), n, at))
            at += n * np.dtype(kind.decode()).itemsize
    return pa.table(columns)


def unpack(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([unpacked(b) for b in blobs.to_pylist()])
