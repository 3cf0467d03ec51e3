"""Large quoted CSV and JSON files, read by many tasks.

Spark's text source cuts a file to byte ranges and hands out pieces that end with a separator: lines for CSV,
text up to a closing brace for JSON. Whether a piece begins inside a quoted value, and for JSON
how deep, depends on all that precedes it in the file. A first scan finds what each range does to that state; a prefix
scan over ranges, one row each, gives the state at the start of each; with it, a second scan finds
what lies over the borders of ranges and a third cuts each range to its own records. Parts of records over borders
are put together by a shuffle of themselves. No task holds more than a batch and a record.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

#: Ranges (some 100 bytes each) up to this many are sent to each executor with their states; of more, the pieces are shuffled by range.
RANGES = 500_000
#: Distinct headers of the files that are read together.
HEADERS = 100
#: What Java's trim takes off.
BLANK = "".join(map(chr, range(33)))

WHOLE, HEAD, MIDDLE, TAIL, HEADER, FIELD = range(6)
#: A record or a part of one: the range it begins in, the depth there, the field of the document that it is in, if that is known.
_PART = "file string, block long, kind int, depth long, field string, text string"
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("depth", pa.int64()), ("field", pa.string()), ("text", pa.string())])


def kept(x: DataFrame) -> DataFrame:
    """A small table that several jobs read: written to the checkpoint folder where there is one."""
    spark = x.sparkSession
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return x.checkpoint() if there else x.persist()


def _pieces(spark: SparkSession, path: str | list[str], sep: str, options: dict) -> DataFrame:
    x = spark.read.options(**options).option("lineSep", sep).text(path)
    m = F.col("_metadata")
    return x.select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("total"), F.monotonically_increasing_id().alias("row"))


def _with_state(x: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with the state at the start of their range, each range in order."""
    if states.count() <= RANGES:
        return x.drop("total", "row").join(F.broadcast(states), ["file", "block"])
    return x.drop("total").join(states.hint("merge"), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row").drop("row")


def _before(v: str) -> Column:
    """The sum over a file's ranges before this one."""
    return F.coalesce(F.sum(v).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where a range ends: (file, block), rows."""
    for b in batches:
        if not b.num_rows:
            continue
        block, file = b.column("block").to_numpy(), b.column("file")
        new = block[1:] != block[:-1]
        if len(new):
            new |= pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield (file[i].as_py(), int(block[i])), b.slice(i, j - i)


def _row(at: tuple, kind: int, text: str, depth: int = 0, field: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, kind, depth, field, text), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class _Open:
    """The record at hand of a range: its pieces so far, and whether it began in this range."""

    def __init__(self, at: tuple, own: bool, depth: int = 0, field: str | None = None):
        self.at, self.own, self.depth, self.field = at, own, depth, field
        self.pieces: list[str] = []

    def rows(self, sep: str, closed: bool, whole: bool) -> Iterator[pa.RecordBatch]:
        """whole: only records of this range alone; else only parts of others."""
        kind = (WHOLE if closed else TAIL) if self.own else (HEAD if closed else MIDDLE)
        if self.pieces and (kind == WHOLE) == whole:
            yield _row(self.at, kind, sep.join(self.pieces), self.depth, self.field)


def _csv_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether its quotes turn the state, whether each of its lines is a record as Spark's own reader takes it if the range begins outside quotes, and the file's first line."""
    now, out = None, []
    for at, b in _blocks(batches):
        lines = b.column("value").cast(pa.string())
        if at != now:
            now = at
            out.append([*at, 0, True, lines[0].as_py() if at[1] == 0 else None])
        r, quotes = out[-1], pc.count_substring(lines, '"').to_numpy()
        r[2] = (r[2] + int(quotes.sum())) % 2
        # that reader also ends lines at CR, and passes over those without more than spaces and control characters
        blank = pc.and_(pc.equal(pc.ascii_trim(lines, BLANK), ""), pc.not_equal(lines, ""))
        r[3] = r[3] and not (quotes & 1).any() and not pc.any(pc.match_substring(lines, "\r")).as_py() and not pc.any(blank).as_py()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)], ["file", "block", "own", "plain", "first"])


def _plain_csv(spark: SparkSession, path: str | list[str], states: DataFrame, wanted: StructType, file: str | None, options: dict) -> DataFrame | None:
    """Files whose every line is a record, and which share one header, through Spark's own reader, which parses only what is asked for; else None."""
    if states.where("NOT plain OR odd <> 0").first():
        return None
    found = [r["first"] for r in states.where("block = 0").select("first").distinct().limit(2).collect()]
    header = found[0].removeprefix("\ufeff") if len(found) == 1 else ""
    if not header:
        return None
    names = next(csv.reader([header]))
    types = {f.name: f.dataType for f in wanted}
    # by place, as a folder may give a column too; a name stands for its first place
    ddl = ", ".join(f"`_column{i}` {types[n].simpleString() if n in types and n not in names[:i] else 'string'}" for i, n in enumerate(names))
    x = spark.read.options(**options).options(header=True, escape='"', lineSep="\n", maxColumns=max(20480, len(names) + 1)).schema(ddl).csv(path)
    return x.select(*[(F.col(f"_column{names.index(n)}") if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()], *([F.col("_metadata.file_path").alias(file)] if file else []))


def _csv_parts(header: bool, whole: bool):
    """Lines in order as records of one range, or (whole is false) as headers and parts of records over borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, name = None, 0, False
        for at, b in _blocks(batches):
            if now is None or at != now.at:
                if now:
                    yield from last(now, odd, name)
                odd = b.column("odd")[0].as_py()
                # name: the record at hand is the file's first one
                now, name = _Open(at, odd == 0), header and at[1] == 0
            lines = b.column("value").cast(pa.string())
            quotes = odd + np.cumsum(pc.count_substring(lines, '"').to_numpy())
            starts = np.flatnonzero(np.append(odd, quotes[:-1]) & 1 == 0)
            odd = int(quotes[-1]) & 1
            now.pieces += lines.slice(0, int(starts[0]) if len(starts) else None).to_pylist()
            if not len(starts):
                continue
            if now.pieces:
                yield from last(now, 0, name)
                name = False
            if name and len(starts) > 1:
                if not whole:
                    yield _row(at, HEADER, "\n".join(lines.slice(0, int(starts[1])).to_pylist()))
                starts, name = starts[1:], False
            if whole and len(starts) > 1:
                # binary_join takes lists from their first to their last offset
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), lines), "\n")
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array([WHOLE] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.nulls(n, pa.string()), text], schema=_SCHEMA)
            now = _Open(at, True)
            now.pieces = lines.slice(int(starts[-1])).to_pylist()
        if now:
            yield from last(now, odd, name)

    def last(now: _Open, odd: int, name: bool) -> Iterator[pa.RecordBatch]:
        if name and odd == 0:
            yield from [] if whole else [_row(now.at, HEADER, "\n".join(now.pieces))]
        else:
            yield from now.rows("\n", odd == 0, whole)

    return run


def _joined(parts: DataFrame, sep: str) -> DataFrame:
    """Complete records that lie over borders, in the columns of parts: a tail and the parts up to the next one."""
    over = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    begin = F.max(F.when(F.col("kind") == TAIL, F.col("block"))).over(over)
    marks = parts.where(F.col("kind").isin(HEAD, MIDDLE, TAIL)).select("file", "block", "kind").withColumn("begin", begin).where("begin IS NOT NULL")
    pieces = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    # of one record all pieces, which make one value in the end
    x = parts.join(marks, ["file", "block", "kind"]).groupBy("file", "begin").agg(pieces.alias("p"), F.max(F.when(F.col("kind") == TAIL, F.col("depth"))).alias("depth"), F.max(F.when(F.col("kind") == TAIL, F.col("field"))).alias("field"), F.max((F.col("kind") == HEAD).cast("int")).alias("closed"))
    return x.select("file", F.col("begin").alias("block"), "depth", "field", F.array_join(F.transform("p", lambda v: v["text"]), sep).alias("text"), "closed")


def read_csv_split(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, file: str | None = None, **options) -> DataFrame:
    """Rows of quoted CSV files of any size; values may hold line breaks, commas and doubled quotes.

    header: the first record names the columns, in any order; columns of schema that a file lacks are null, and others are
    left out. Without it columns go by place. A byte order mark and empty lines are passed over. Quotes stand around whole values only
    and are doubled inside; a file that ends inside a value is an error. Values keep their line breaks as they are. Ranges are as long as
    spark.sql.files.maxPartitionBytes. file: a further column, the file's path. options: those of the text source, such as recursiveFileLookup.
    """
    wanted = StructType.fromDDL(schema)
    x = _pieces(spark, path, "\n", options)
    ranges = x.select("value", "file", "block").mapInArrow(_csv_ranges, "file string, block long, own int, plain boolean, first string")
    states = kept(ranges.withColumn("odd", (_before("own") % 2).cast("int")))
    broken = states.groupBy("file").agg((F.sum("own") % 2).alias("open")).where("open = 1").first()
    if broken:
        raise ValueError(f"{broken.file} ends inside a quoted value")
    plain = _plain_csv(spark, path, states, wanted, file, options) if header else None
    if plain is not None:
        return plain
    lines = _with_state(x, states.select("file", "block", "odd"))
    parts = kept(lines.mapInArrow(_csv_parts(header, False), _PART))
    records = lines.mapInArrow(_csv_parts(header, True), _PART).select("file", "text").unionByName(_joined(parts, "\n").select("file", "text"))
    records = records.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
    if not header:
        return _parsed(records, wanted.names, wanted, file)
    heads = parts.where(F.col("kind") == HEADER).select("file", F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r$", "").alias("header"))
    found = [r.header for r in heads.select("header").distinct().limit(HEADERS + 1).collect()]
    if len(found) > HEADERS:
        raise ValueError(f"the files have more than {HEADERS} different headers")
    out = _parsed(records.limit(0), wanted.names, wanted, file)
    for h in found:
        own = records if len(found) == 1 else records.join(heads.where(F.col("header") == h).select("file"), "file", "left_semi")
        out = out.unionByName(_parsed(own, next(csv.reader([h])), wanted, file))
    return out


def _parsed(records: DataFrame, names: list[str], wanted: StructType, file: str | None) -> DataFrame:
    """Records (file, text) with columns names, as rows of wanted."""
    types: dict[str, DataType] = {f.name: f.dataType for f in wanted}
    own = [n if n in types and n not in names[:i] else f"_unused{i}" for i, n in enumerate(names)]
    ddl = ", ".join(f"`{n}` {types.get(n, StringType()).simpleString()}" for n in own)
    x = records.select("file", F.from_csv("text", ddl, {"multiLine": "true", "escape": '"', "maxColumns": str(max(20480, len(own) + 1))}).alias("r"))
    return x.select(*[(F.col("r")[n] if n in own else F.lit(None).cast(t)).alias(n) for n, t in types.items()], *([F.col("file").alias(file)] if file else []))


_ESCAPED = re.compile(r"\\.", re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _outside(piece: str, inside: bool) -> tuple[str, bool]:
    """A piece without what is in quotes, and whether it ends inside them. Backslashes stand inside only, so what they escape goes first, whatever the state."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    return "".join(parts[int(inside) :: 2]), (len(parts) % 2 == 0) != inside


def _deeper(outside: str, inside: bool) -> int:
    """What a piece does to the depth, the brace that ends it included unless that is inside quotes."""
    return outside.count("{") + outside.count("[") - outside.count("]") - (not inside)


def _json_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state: whether it turns inside to outside, and its depth from either."""
    now, out = None, []
    for at, b in _blocks(batches):
        if at != now:
            now = at
            out.append([*at, b.column("total")[0].as_py(), 0, [False, True], [0, 0]])
        r = out[-1]
        for p in b.column("value").to_pylist():
            r[3] += len(p.encode()) + 1
            for i in (0, 1):
                text, r[4][i] = _outside(p, r[4][i])
                r[5][i] += _deeper(text, r[4][i])
    if out:
        cols = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [r[3] for r in out], [int(r[4][0]) for r in out], [r[5][0] for r in out], [r[5][1] for r in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], ["file", "block", "total", "bytes", "turns", "from_out", "from_in"])


def _last_field(piece: str, inside: bool, depth: int) -> str | None:
    """The last field name of the document's own object that a piece has; empty if it begins in another piece."""
    found = None
    if inside:
        m = _REST.match(piece)
        if not m:
            return None
        piece = piece[m.end() :]
        if depth == 1 and piece.lstrip().startswith(":"):
            found = ""
    for m in _TOKEN.finditer(piece):
        t = m[0]
        if t in "{[":
            depth += 1
        elif t in "]}":
            depth -= 1
        elif depth == 1 and piece[m.end() :].lstrip()[:1] == ":":
            found = json.loads(t)
    return found


def _json_parts(base: int, whole: bool):
    """Pieces in order as units, each of which ends where an object at depth base does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, field = None, False, 0, None
        for at, b in _blocks(batches):
            if now is None or at != now.at:
                if now:
                    yield from last(now, field)
                inside, depth, field = b.column("inside")[0].as_py() == 1, b.column("depth")[0].as_py(), None
                now = _Open(at, at[1] == 0 or not inside and depth == base, depth)
            for p in b.column("value").to_pylist():
                text, then = _outside(p, inside)
                if base == 2 and depth - text.count("]") <= 1:
                    seen = _last_field(p, inside, depth)
                    field = field if seen is None else seen
                now.pieces.append(p)
                inside, depth = then, depth + _deeper(text, then)
                if not inside and depth == base:
                    yield from now.rows("}", True, whole)
                    now = _Open(at, True, depth, field)
        if now:
            yield from last(now, field)

    def last(now: _Open, field: str | None) -> Iterator[pa.RecordBatch]:
        yield from now.rows("}", False, whole)
        if not whole and field is not None:
            yield _row(now.at, FIELD, "", 0, field)

    return run


def _object(unit: str, depth: int, base: int) -> tuple[str | None, str | None, str | None]:
    """Of a unit that begins at depth: the last field before its object, the object's key, and the object."""
    field = key = None
    for m in _TOKEN.finditer(unit):
        t = m[0]
        if t == "{" and depth == base:
            return field, key, unit[m.start() :]
        if t in "{[":
            depth, key = depth + 1, None
        elif t in "]}":
            depth, key = depth - 1, None
        else:
            named = unit[m.end() :].lstrip()[:1] == ":"
            key = json.loads(t) if named else None
            field = key if named and depth == 1 else field
    return None, None, None


def _objects(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_object(t + "}", d, base) for t, d in zip(b.column("text").to_pylist(), b.column("depth").to_pylist(), strict=True)]
            fields = [f if f is not None else g for (f, _, _), g in zip(got, b.column("field").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(fields, pa.string()), pa.array([k for _, k, _ in got], pa.string()), pa.array([o for _, _, o in got], pa.string())], ["file", "block", "field", "key", "object"])

    return run


def read_json_split(spark: SparkSession, path: str | list[str], schema: str, field: str | None = None, key: str | None = None, **options) -> DataFrame:
    """Objects of JSON files of any size, each file one document: an array of objects, or an object whose values are objects.

    field: the document is an object, and the array or object is the value of that field of it. key: a further column, the name
    that an object has in the one around it. Other values beside the objects are passed over, and objects
    inside them. A file that ends inside a value is an error. Ranges and options are those of read_csv_split.
    """
    base = 1 if field is None else 2
    x = _pieces(spark, path, "}", options)
    did = kept(x.drop("row").mapInArrow(_json_ranges, "file string, block long, total long, bytes long, turns long, from_out long, from_in long"))
    states = did.withColumn("inside", _before("turns") % 2).withColumn("own", F.expr("if(inside = 0, from_out, from_in)"))
    states = kept(states.withColumn("depth", _before("own")))
    # the last piece counts a brace that is not there unless the file ends with one
    ends = states.groupBy("file").agg(F.sum("turns").alias("turns"), F.sum("own").alias("depth"), (F.sum("bytes") - F.max("total")).alias("more"))
    broken = ends.where("turns % 2 = 1 OR depth + more <> 0").first()
    if broken:
        raise ValueError(f"{broken.file} ends inside a value")
    pieces = _with_state(x, states.select("file", "block", "inside", "depth"))
    parts = kept(pieces.mapInArrow(_json_parts(base, False), _PART))
    units = pieces.mapInArrow(_json_parts(base, True), _PART).select("file", "block", "depth", "field", "text")
    units = units.unionByName(_joined(parts, "}").where("closed = 1").drop("closed"))
    got = units.mapInArrow(_objects(base), "file string, block long, field string, key string, object string").where("object IS NOT NULL")
    if field is not None:
        # the field at the start of a range is the last one of those before
        w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        names = parts.where(F.col("kind") == FIELD).select("file", "block", F.col("field").alias("name"))
        names = states.select("file", "block").join(names, ["file", "block"], "left").select("file", "block", F.last("name", True).over(w).alias("before"))
        few = F.broadcast(names) if states.count() <= RANGES else names
        got = got.join(few, ["file", "block"], "left").where(F.coalesce("field", "before") == field)
    out = got.select(*([F.col("key").alias(key)] if key else []), F.from_json("object", schema).alias("_object"))
    return out.select(*([key] if key else []), "_object.*")
