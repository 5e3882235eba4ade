"""VOTable catalogs (TABLEDATA): header on the driver, rows as a Spark data source.

    spark.dataSource.register(VoTable); spark.read.format("votable").load(path)
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

#: datatype -> (Spark type, arrow type, what an empty cell becomes)
TYPES = {
    "boolean": ("boolean", pa.bool_(), False),
    "unsignedByte": ("smallint", pa.int16(), 0),
    "short": ("smallint", pa.int16(), 0),
    "int": ("int", pa.int32(), 0),
    "long": ("bigint", pa.int64(), 0),
    "float": ("float", pa.float32(), float("nan")),
    "double": ("double", pa.float64(), float("nan")),
    "char": ("string", pa.string(), ""),
    "unicodeChar": ("string", pa.string(), ""),
}


@dataclass
class Field:
    name: str
    id: str
    datatype: str
    arraysize: str | None
    unit: str
    ucd: str
    description: str = ""

    @property
    def supported(self) -> bool:
        return self.datatype in TYPES and (self.arraysize is None or self.datatype in ("char", "unicodeChar"))


@dataclass
class Header:
    name: str = ""
    description: str = ""
    rows: int | None = None
    fields: list[Field] = field(default_factory=list)
    params: dict[str, str] = field(default_factory=dict)
    coosys: list[dict[str, str]] = field(default_factory=list)
    has_data: bool = False

    def find(self, name_or_id: str) -> Field | None:
        """By id, else by name; the last of equal ones."""
        for key in ("id", "name"):
            found = [f for f in self.fields if getattr(f, key) == name_or_id]
            if found:
                return found[-1]
        return None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def read_header(path: str) -> Header:
    """Everything before the rows of the first table of the first resource; reading stops at the data."""
    path = path.removeprefix("file://").removeprefix("file:")
    out, stack, table, resource = Header(), [], None, False
    for event, e in ET.iterparse(path, events=("start", "end")):
        tag = _local(e.tag)
        if event == "start":
            stack.append(tag)
            if tag == "RESOURCE":
                resource = True
            if tag == "TABLE" and table is None:
                table = e
                out.name = e.get("name", "")
                out.rows = int(e.get("nrows")) if e.get("nrows", "").isdigit() else None
            if tag == "DATA" and table is not None:
                out.has_data = True
                break
            continue
        stack.pop()
        if tag == "FIELD":
            text = next((c.text or "" for c in e if _local(c.tag) == "DESCRIPTION"), "")
            out.fields.append(Field(e.get("name", ""), e.get("ID", ""), e.get("datatype", ""), e.get("arraysize"), e.get("unit", ""), e.get("ucd", ""), text.strip()))
        elif tag == "PARAM":
            out.params[e.get("name", "")] = e.get("value", "")
        elif tag == "COOSYS":
            out.coosys.append(dict(e.attrib))
        elif tag == "DESCRIPTION" and stack and stack[-1] in ("RESOURCE", "TABLE", "VOTABLE") and not out.description:
            out.description = (e.text or "").strip()
        elif tag == "TABLE":
            break
    if not resource:
        raise ValueError("no RESOURCE in the file")
    if table is None:
        raise ValueError("no TABLE in the file")
    return out


def columns(header: Header) -> list[tuple[int, str, str]]:
    """(position, column name, Spark type) of the supported fields; repeated names get a number."""
    out, seen = [], {"row_id"}
    for i, f in enumerate(header.fields):
        if not f.supported:
            continue
        name = base = f.name or f.id or f"col{i}"
        n = 2
        while name.lower() in seen:
            name, n = f"{base}_{n}", n + 1
        seen.add(name.lower())
        out.append((i, name, TYPES[f.datatype][0]))
    return out


def _cell(text: str, datatype: str):
    empty = TYPES[datatype][2]
    if datatype in ("char", "unicodeChar"):
        return text
    text = text.strip()
    if datatype == "boolean":
        return text[:1] in ("t", "T", "1")
    try:
        return float(text) if datatype in ("float", "double") else int(text, 0)
    except ValueError:
        return empty


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def read(self, partition):
        header = read_header(self.path)
        if not header.has_data:
            raise ValueError("the table has no data")
        picked = [(i, header.fields[i].datatype) for i, _, _ in columns(header)]
        names = ["row_id", *[n for _, n, _ in columns(header)]]
        kinds = [pa.int64(), *[TYPES[d][1] for _, d in picked]]
        rows, n = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)
        for _, e in ET.iterparse(self.path.removeprefix("file://").removeprefix("file:"), events=("end",)):
            tag = _local(e.tag)
            if tag == "TR":
                cells = [c.text or "" for c in e if _local(c.tag) == "TD"]
                rows.append((n, *[_cell(cells[i], d) if i < len(cells) else TYPES[d][2] for i, d in picked]))
                n += 1
                e.clear()
                if len(rows) == 10_000:
                    yield batch()
                    rows.clear()
            elif tag == "TABLE":
                break
        if rows:
            yield batch()


class VoTable(DataSource):
    """The first table of a VOTable file, with row_id; one file is read as one stream, many files as many tasks."""

    @classmethod
    def name(cls):
        return "votable"

    def schema(self):
        return "row_id bigint" + "".join(f", `{n}` {kind}" for _, n, kind in columns(read_header(self.options["path"])))

    def reader(self, schema):
        return _Reader(self.options)
