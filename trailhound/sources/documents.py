"""Large JSON documents cut into records without any task reading a whole file.

A document is read in the pieces between its closing braces, so Spark can split it anywhere.
What a block of pieces does to the reader's state (inside a string or not, and how deep) is a
small function: for each of the two string states at its start, the depth it adds. Composed
along the blocks of a file they give each block's true start, and a second read cuts the text
at the commas of depth one (and two, in an object: the elements of its lists). Only texts that
cross a block's edge are put together by a shuffle.

A document holds up as a whole or not at all: if any part of it is no JSON, none of its
records are taken and its lines are read instead, as for a small one. An object without a list
of records is one record, and a record is a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailhound.functions.json_values import strict_json, with_json
from trailhound.session import materialize

#: Bytes from which a document is cut; smaller ones are a row each.
LARGE_BYTES = 64 << 20
#: Characters of a large file's head by which its format is told.
HEAD_CHARS = 1 << 20
#: Text a task gathers before it sends rows on.
SEND_CHARS = 4 << 20
_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{},]', re.S)
_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
#: A member's key, and what its value begins with where that is a list.
_WHITE = r"[ \t\r\n]*"
_KEY = rf'^{_WHITE}("(?:[^"\\]|\\.)*+"){_WHITE}:{_WHITE}'
_MEMBER = rf"{_KEY}(\[?)"
#: What stands before or behind a text: nothing, a comma of depth one, the file's edge.
NOTHING, COMMA, EDGE = 0, 1, 2


def as_patterns(files: list[str]) -> list[str]:
    """Names of scans are URI-encoded, paths to read are patterns."""
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in files]


def large_files(spark: SparkSession, path: str | list[str], at_least: int = LARGE_BYTES) -> list[str]:
    """The names of files of so many bytes or more: at most one for every `at_least` bytes of
    input. Sizes come from the file index, nothing is read."""
    sizes = spark.read.format("binaryFile").load(path).select("length", F.col("_metadata.file_path").alias("file"))
    return [r["file"] for r in sizes.filter(F.col("length") >= at_least).select("file").collect()]


def file_heads(spark: SparkSession, files: list[str], chars: int = HEAD_CHARS) -> DataFrame:
    """(file, line_no, value): the lines of each file's head. Read between colons, which stand
    in log lines as in JSON, so that neither a file of one line nor one without braces is a row."""
    rows = spark.read.option("lineSep", ":").text(as_patterns(files)).select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).filter("block = 0")

    def work(batches):
        open_file, held, size = None, [], 0
        for batch in batches:
            # A block's rows follow each other, so nothing of this batch is still to be held.
            if batch.num_rows and size >= chars and {batch["file"][0].as_py(), batch["file"][-1].as_py()} == {open_file}:
                continue
            for file, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist()):
                if file != open_file:
                    if held:
                        yield _rows(["file", "head"], [(open_file, ":".join(held))])
                    open_file, held, size = file, [], 0
                if size < chars:
                    held.append(value)
                    size += len(value) + 1
        if held:
            yield _rows(["file", "head"], [(open_file, ":".join(held))])

    heads = rows.select("file", "value").mapInArrow(work, "file string, head string")
    return heads.select("file", F.posexplode(F.split(F.substring("head", 1, chars), "\r\n|[\r\n]")).alias("at", "value")).select(
        "file", (F.col("at") + 1).cast("long").alias("line_no"), "value"
    )


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {str: pa.string(), int: pa.int64(), bool: pa.bool_()}
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[type(c[0])]) for c in columns], names)


def _pieces(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, value, bytes, size). Blocks are Spark's splits, and those follow the cores it
    has when a read begins, so they would change with the executors. They are read twice and must
    be the same, so the reader's session of its own keeps the number as it is now."""
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    reader = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        reader.conf.set(name, spark.conf.get(name))
    reader.conf.set("spark.sql.files.minPartitionNum", cores)
    return reader.read.option("lineSep", "}").text(as_patterns(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"), F.octet_length("value").cast("long").alias("bytes"),
        F.col("_metadata.file_size").alias("size"),
    )


def few_rows(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A table with a row for each block or large file, to be sent to all tasks unless it is so
    large that Spark should choose."""
    return F.broadcast(table) if table.count() <= most else table


def effect(text: str) -> tuple[int, int, int]:
    """Whether a text ends in the other string state than it began in, and the depth it adds if
    it began outside and inside a string."""
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    out, inside = "".join(parts[::2]), "".join(parts[1::2])

    def depth(s: str) -> int:
        return s.count("{") + s.count("[") - s.count("}") - s.count("]")

    return (len(parts) - 1) % 2, depth(out), depth(inside)


def block_effects(pieces: DataFrame) -> DataFrame:
    """(file, block, odd, outside, inside, first, bytes, size): the effect of each block, its
    first character that is no white space, its bytes with a brace behind each piece, and those
    of the file."""
    names = ["file", "block", "odd", "outside", "inside", "first", "bytes", "size"]

    def work(batches):
        key, odd, depths, first, read, whole = None, 0, [0, 0], "", 0, 0

        def row():
            return _rows(names, [(*key, odd, *depths, first, read, whole)])

        for batch in batches:
            for file, block, value, length, size in zip(*(batch[c].to_pylist() for c in ("file", "block", "value", "bytes", "size"))):
                if (file, block) != key:
                    if key:
                        yield row()
                    # The brace before a block's first piece is its own.
                    key, odd, depths, first, read, whole = (file, block), 0, [0, 0], "", 0, size
                    value = "}" + value if block else value
                else:
                    value = "}" + value
                read += length + 1
                first = first or value.lstrip(" \t\r\n")[:1]
                o, *d = effect(value)
                # What began outside is inside after an odd number of quotes.
                depths = [depths[0] + d[odd], depths[1] + d[1 - odd]]
                odd ^= o
        if key:
            yield row()

    return pieces.mapInArrow(work, "file string, block long, odd long, outside long, inside long, first string, bytes long, size long")


def block_starts(effects: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, root, missing): the state each block begins in, what the
    file begins with, and for its last block whether its last piece had a brace behind it, which
    only the file's length tells (a scan also leaves out a mark of three bytes at its start)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        effects.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
        .withColumn("adds", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
        .withColumn("depth", F.coalesce(F.sum("adds").over(before), F.lit(0)))
        .select(
            "file", "block", "in_string", "depth",
            F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(whole).alias("root"),
            ((F.col("size") - F.sum("bytes").over(whole)).isin(0, 3) & (F.max("block").over(whole) == F.col("block"))).alias("missing"),
        )
    )


class Cutter:
    """Text of one block, piece by piece, to fragments between the commas that separate records."""

    def __init__(self, in_string: int, depth: int, deepest: int):
        self.in_string, self.depth, self.deepest = bool(in_string), depth, deepest
        self.member = self.element = 0
        self.held: list[str] = []
        self.head = NOTHING

    def add(self, text: str) -> Iterator[tuple[int, int, int, int, str]]:
        """(member, element, head, tail, text) of the fragments that end in this text."""
        at = begin = 0
        if self.in_string:
            end = _STRING_REST.match(text)
            if end is None:
                self.held.append(text)
                return
            at, self.in_string = end.end(), False
        left = text.count("]", at) + text.count("}", at)
        while True:
            if self.depth - left > self.deepest:  # nothing here comes up to where records are cut
                odd, depth, _ = effect(text[at:])
                self.in_string, self.depth = bool(odd), self.depth + depth
                break
            token = _TOKEN.search(text, at)
            if token is None:
                break
            at, c = token.end(), token.group()
            if c[0] == '"':
                left -= c.count("]") + c.count("}")
                if len(c) == 1 or c[-1] != '"' or _STRING_REST.match(c, 1) is None:
                    self.in_string = True
                    break
            elif c == ",":
                if 1 <= self.depth <= self.deepest:
                    outer = COMMA if self.depth == 1 else NOTHING
                    self.held.append(text[begin:at - 1])
                    yield self.member, self.element, self.head, outer, "".join(self.held)
                    self.held, self.head, begin = [], outer, at
                    self.member, self.element = self.member + (outer == COMMA), self.element + (outer != COMMA)
            elif c in "[{":
                self.depth += 1
            else:
                self.depth -= 1
                left -= 1
        self.held.append(text[begin:])


FRAGMENT = "file string, block long, at long, member long, element long, head long, tail long, root string, last boolean, text string"
_NAMES = ["file", "block", "at", "member", "element", "head", "tail", "root", "last", "text"]


def fragments(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """The fragments of all blocks, numbered within them; `last` ends its block."""

    def work(batches):
        key, cutter, at, rows, size, close, root = None, None, 0, [], 0, False, ""

        def end():
            text = "".join(cutter.held) + ("}" if close else "")
            return (*key, at, cutter.member, cutter.element, cutter.head, NOTHING, root, True, text)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("file", "block", "value", "in_string", "depth", "root", "missing")]
            for file, block, value, in_string, depth, begins, missing in zip(*columns):
                if (file, block) != key:
                    if key:
                        rows.append(end())
                    key, at, close, root = (file, block), 0, missing, begins or ""
                    cutter = Cutter(in_string, depth, 2 if root == "{" else 1)
                    cutter.head = NOTHING if block else EDGE
                    value = "}" + value if block else value
                else:
                    value = "}" + value
                for member, element, head, tail, text in cutter.add(value):
                    rows.append((*key, at, member, element, head, tail, root, False, text))
                    at, size = at + 1, size + len(text)
                if size > SEND_CHARS:
                    if rows:
                        yield _rows(_NAMES, rows)
                    rows, size = [], 0
        if key:
            rows.append(end())
        if rows:
            yield _rows(_NAMES, rows)

    return pieces.join(few_rows(starts), ["file", "block"]).select(
        "file", "block", "value", "in_string", "depth", "root", "missing"
    ).mapInArrow(work, FRAGMENT)


def elements(cut: DataFrame) -> DataFrame:
    """(file, member, element, head, tail, root, text): whole texts between commas; only those
    that cross the edges of blocks meet in a shuffle."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = cut.filter("last").select(
        "file", "block",
        F.coalesce(F.sum("member").over(before), F.lit(0)).alias("members"),
        F.coalesce(F.sum("element").over(before), F.lit(0)).alias("elements"),
        (F.max("block").over(ends) == F.col("block")).alias("final"),
    )
    placed = cut.join(few_rows(blocks), ["file", "block"]).select(
        "file", "block", "at", "root", "text", "head",
        F.when(F.col("last") & F.col("final"), EDGE).otherwise(F.col("tail")).alias("tail"),
        (F.col("member") + F.col("members")).alias("member"), (F.col("element") + F.col("elements")).alias("element"),
        ((F.col("at") == 0) & (F.col("block") > 0) | F.col("last")).alias("edge"),
    )
    whole = placed.filter("NOT edge").select("file", "member", "element", "head", "tail", "root", "text")
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "text")))
    joined = placed.filter("edge").groupBy("file", "member", "element").agg(
        F.max("head").alias("head"), F.max("tail").alias("tail"), F.first("root").alias("root"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )
    return whole.unionByName(joined)


def _without(text: Column, pattern: str) -> Column:
    """The text without what the pattern matches, NULL if it does not."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, ""))


@dataclass(frozen=True)
class CutDocuments:
    """Records of lists (file, line_no, v, odd), objects without such a list as whole texts
    (file, content), and the names of files that are no JSON document."""

    records: DataFrame
    objects: DataFrame
    broken: DataFrame


def cut_documents(spark: SparkSession, files: list[str]) -> CutDocuments:
    """The records of the named files, each of which is JSON as a whole or broken."""
    pieces = _pieces(spark, files)
    starts = materialize(block_starts(block_effects(pieces)))
    found = materialize(elements(materialize(fragments(pieces, starts))))
    text, first, last = F.col("text"), F.col("head") == EDGE, F.col("tail") == EDGE
    # Of an object's list "Records" the elements are records; of repeated keys the last counts.
    inner = F.when(first, F.regexp_replace(text, rf"^{_WHITE}\{{", "")).otherwise(text)
    key = F.try_variant_get(F.try_parse_json(F.regexp_extract(inner, _MEMBER, 1)), "$", "string")
    bundles = found.filter((F.col("root") == "{") & (F.col("head") != NOTHING) & (key == "Records"))
    chosen = bundles.groupBy("file").agg(
        F.max_by(F.struct(F.col("member").alias("chosen"), F.col("element").alias("begin"), (F.regexp_extract(inner, _MEMBER, 2) == "[").alias("list")), "member").alias("c")
    )
    chosen = materialize(chosen.filter("c.list").select("file", "c.chosen", "c.begin"))
    of_objects = found.filter((F.col("root") == "{")).join(few_rows(chosen), "file", "left")
    mine = F.coalesce(F.col("member") == F.col("chosen"), F.lit(False))
    opened = F.when(F.col("element") == F.col("begin"), _without(inner, rf"{_KEY}\[")).otherwise(text)
    closed = F.when(last, _without(F.col("value"), rf"\]{_WHITE}\}}{_WHITE}\z")).when(
        F.col("tail") == COMMA, _without(F.col("value"), rf"\]{_WHITE}\z")
    ).otherwise(F.col("value"))
    bundled = of_objects.filter(mine).withColumn("value", opened).select(
        "file", (F.col("element") - F.col("begin") + 1).alias("line_no"), closed.alias("value"),
        ((F.col("element") == F.col("begin")) & (F.col("tail") != NOTHING)).alias("only"),
    )
    top = found.filter(F.col("root") == "[").withColumn(
        "value", F.when(first, _without(text, rf"^{_WHITE}\[")).otherwise(text)
    ).select(
        "file", (F.col("member") + 1).alias("line_no"),
        F.when(last, _without(F.col("value"), rf"\]{_WHITE}\z")).otherwise(F.col("value")).alias("value"),
        (first & last).alias("only"),
    )
    # An empty list is one blank text.
    blank = F.col("only") & F.col("value").rlike(rf"^{_WHITE}\z")
    listed = materialize(
        with_json(bundled.unionByName(top).filter(~F.coalesce(blank, F.lit(False))), F.col("value"), "v", "odd")
        .select("file", "line_no", "v", "odd")
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element", "text"))), lambda p: p["text"]), ",")
    # The other members of an object with a list are only held to be JSON.
    others = of_objects.filter(F.col("chosen").isNotNull() & ~mine).groupBy("file", "member").agg(
        whole.alias("text"), F.max("head").alias("head"), F.max("tail").alias("tail")
    )
    body = F.when(last, _without(inner, rf"\}}{_WHITE}\z")).otherwise(inner)
    sound = body.rlike(_MEMBER) & strict_json(F.concat(F.lit("{"), body, F.lit("}"))).isNotNull()
    in_order = F.sort_array(F.collect_list(F.struct("member", "element", "text")))
    objects = of_objects.filter(F.col("chosen").isNull()).groupBy("file").agg(
        F.array_join(F.transform(in_order, lambda p: p["text"]), ",").alias("content")
    )
    broken = (
        listed.filter(F.col("v").isNull()).select("file")
        .unionByName(others.filter(~F.coalesce(sound, F.lit(False))).select("file"))
        .unionByName(found.filter(~F.coalesce(F.col("root").isin("{", "["), F.lit(False))).select("file"))
        .distinct()
    )
    broken = materialize(broken)
    return CutDocuments(listed.join(few_rows(broken), "file", "left_anti"), objects, broken)
