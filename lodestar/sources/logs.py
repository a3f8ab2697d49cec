"""New lines of growing log files, by byte offset."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: lines of a web server's access log, which are left out.
ACCESS = re.compile(r"\d+\.\d+\.\d+\.\d+.*HTTP")
#: Bytes that are read of a log at once, lines of other lengths whole.
PIECE = 16 << 20
TAIL = T.StructType().add("position", T.LongType()).add("lines", T.ArrayType(T.StringType()))


@F.arrow_udf(TAIL)
def _tail(path: pa.Array, position: pa.Array) -> pa.Array:
    ends, lines = [], []
    for p, at in zip(path.to_pylist(), position.to_pylist(), strict=True):
        try:
            with open(p, "rb") as f:
                f.seek(at)
                data = f.read(PIECE)
                if len(data) == PIECE and not data.endswith(b"\n"):  # there is more: up to the end of a line
                    data = data[: data.rfind(b"\n") + 1] or data + f.readline()
        except OSError:
            data = b""
        ends.append(at + len(data))
        lines.append([x for x in data.decode(errors="replace").splitlines() if x.strip() and not ACCESS.search(x)])
    return pa.StructArray.from_arrays([pa.array(ends, pa.int64()), pa.array(lines, pa.list_(pa.string()))], TAIL.names)


def tail(files: DataFrame, path: str = "path", position: str = "position") -> DataFrame:
    """``files`` with the position after what was read, and the array of its lines.

    Blank lines and those of access logs are left out, invalid bytes become U+FFFD, and a
    file that can't be read stays where it was. Each file is read by one task from its
    position on, PIECE bytes at most; of what is longer, the next call reads on from the new position.
    """
    rest = [c for c in files.columns if c not in (position, "lines")]
    return files.select(*rest, _tail(F.col(path), F.col(position)).alias("t")).select(*rest, F.col("t.position").alias(position), "t.lines")
