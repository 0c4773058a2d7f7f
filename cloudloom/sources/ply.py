"""PLY point files (ASCII, binary little- or big-endian), one partition a file, Arrow batches."""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Scalar types of the format and their numpy codes.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_header(path: str) -> tuple[str, int, list[tuple[str, str]], int]:
    """(encoding, vertices, [(property, type)], offset of the data). Vertices must be the first element."""
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: not a PLY file")
        encoding, n, props, element = "", 0, [], None
        for line in iter(f.readline, b""):
            w = line.decode("ascii", "replace").split()
            if not w or w[0] in ("comment", "obj_info"):
                continue
            if w[0] == "format":
                encoding = w[1]
            elif w[0] == "element":
                if element is None and w[1] != "vertex":
                    raise ValueError(f"{path}: the first element is not vertex")
                element = w[1]
                n = int(w[2]) if element == "vertex" else n
            elif w[0] == "property" and element == "vertex":
                if w[1] == "list":
                    raise ValueError(f"{path}: lists in vertices are not supported")
                props.append((w[2], TYPES[w[1]]))
            elif w[0] == "end_header":
                return encoding, n, props, f.tell()
    raise ValueError(f"{path}: the header has no end")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], schema, finite: bool):
        self.files, self.schema, self.finite = files, schema, finite

    def partitions(self):
        return [_File(p) for p in self.files] or [_File("")]

    def read(self, part: _File):
        if not part.path:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        encoding, n, props, at = read_header(part.path)
        if encoding == "ascii":
            with open(part.path, "rb") as f:
                f.seek(at)
                rows = [f.readline().split()[: len(props)] for _ in range(n)]
            data = {p: np.array([r[i] for r in rows], dtype=np.float64) for i, (p, _) in enumerate(props)}
        else:
            order = "<" if encoding == "binary_little_endian" else ">"
            table = np.memmap(part.path, np.dtype([(p, order + t) for p, t in props]), "r", at, (n,))
            data = {p: table[p] for p, _ in props}
        for s in range(0, n, 65536):
            e = min(s + 65536, n)
            keep = np.ones(e - s, bool)
            if self.finite:
                for c in "xyz":
                    keep &= np.isfinite(np.asarray(data[c][s:e], np.float64))
            cols = []
            for f in schema:
                if f.name == "id":
                    cols.append(pa.array(np.arange(s, e)[keep]))
                elif f.name == "file":
                    cols.append(pa.array([os.path.basename(part.path)] * int(keep.sum())))
                elif f.name in data:
                    v = np.asarray(data[f.name][s:e])[keep]
                    cols.append(pa.array(v.astype(v.dtype.newbyteorder("=")), type=f.type, safe=False))
                else:
                    cols.append(pa.nulls(int(keep.sum()), f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


class Ply(DataSource):
    """spark.read.format("ply").option("finite", "true").load(path): file, id and the vertex properties.

    The columns are those of the first file; a property another file lacks is null.
    ``finite`` leaves out vertices without three finite coordinates.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _files(self) -> list[str]:
        path = self.options.get("path", "")
        return sorted(glob.glob(os.path.join(path, "*.ply")) if os.path.isdir(path) else glob.glob(path))

    def schema(self) -> str:
        files = self._files()
        if not files:
            raise ValueError("no PLY file there")
        _, _, props, _ = read_header(files[0])
        kind = {"i1": "int", "u1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
        return ", ".join(["file string", "id bigint", *[f"`{p}` {kind[t]}" for p, t in props]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._files(), schema, self.options.get("finite", "false").lower() == "true")


def write_ply(table: pa.Table, path: str) -> None:
    """Numeric columns as a binary little-endian file; for results small enough for the driver."""
    names = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
    cols = {c: table.column(c).to_numpy() for c in table.column_names}
    cols = {c: v.astype("<i4") if v.dtype == np.int64 else v for c, v in cols.items()}
    rows = np.empty(table.num_rows, [(c, "<" + v.dtype.str[1:]) for c, v in cols.items()])
    for c, v in cols.items():
        rows[c] = v
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property {names[v.dtype.str[1:]]} {c}" for c, v in cols.items()], "end_header", ""]
    with open(path, "wb") as f:
        f.write("\n".join(head).encode() + rows.tobytes())
