"""Keyed tables as text: header grammar, scanning, casts and writing.

A file may start with ``#: :key=value#:key=value`` (options) and a line
``#Key<TAB>Field...``. The driver reads the first lines of each file only; the
scan itself is Spark's text source and column functions.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, keyed
from keyloom.operators.aggregates import numbered
from keyloom.operators.load import first_wins, merge, merge_zipped
from keyloom.operators.shape import records, to_double


#: Files whose headers are broadcast if they differ.
FILES = 100_000


def option_value(text: str):
    if text.startswith(":"):
        return text[1:]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    return text


def parse_options(text: str) -> dict:
    """``:type=:flat#:merge=true`` as a dict."""
    pairs = (x.partition("=") for x in text.split("#") if x.strip())
    return {k.strip().lstrip(":"): option_value(v.strip()) if eq else True for k, eq, v in pairs}


def format_options(options: dict) -> str:
    def shown(v):
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f":{v}" if re.fullmatch(r"\w+", str(v)) else f"'{v}'"

    return "#".join(f":{k}={shown(v)}" for k, v in options.items())


def parse_open_string(text: str) -> dict:
    """``Key~F1,F2#:type=:flat``: key, fields and options."""
    selection, _, options = text.partition("#")
    key, tilde, fields = selection.partition("~")
    out = parse_options(options)
    if tilde:
        out |= {"key_field": key, "fields": fields.split(",")}
    elif key:
        out["type"] = key
    return out


def pattern(sep: str) -> str:
    """A separator as a regular expression: as it is between slashes, else
    literal."""
    return sep[1:-1] if len(sep) > 2 and sep[0] == sep[-1] == "/" else re.escape(sep)


def parse_header(lines: list[str], sep: str = "\t", mark: str | bool = "#") -> tuple[dict, list[str] | None]:
    """Options, and the names in the header line if there is one: of the lines
    at the top that start with the mark, the last. With an empty mark, or True,
    the first line is the header, whatever it starts with, and no line has
    options; with False there is none."""
    options, names, _ = _head(lines, sep, mark)
    return options, names


def _head(lines: list[str], sep: str, mark: str | bool) -> tuple[dict, list[str] | None, list[str]]:
    """Options, names, and the marked lines before the header."""
    if mark is False:
        return {}, None, []
    split = lambda line, by: [x.strip() for x in re.split(pattern(by), line)]
    if mark is True or not mark:
        return {}, split(lines[0], sep) if lines else None, []
    options: dict = {}
    if lines and lines[0].startswith(f"{mark}: "):
        options, lines = parse_options(lines[0][len(mark) + 2 :]), lines[1:]
    marked = list(itertools.takewhile(lambda x: x.startswith(mark), lines))
    if not marked:
        return options, None, []
    return options, split(marked[-1][len(mark) :], str(options.get("sep", sep))), marked[:-1]


def first_lines(spark: SparkSession, path: str, mark: str | bool = "#") -> list[str]:
    """The lines at a file's top that start with the mark, and the next one.
    Read by way of the file system that Spark uses, as footers are when a
    schema is inferred; no more of the file than that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = where.getFileSystem(conf).open(where)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    lines: list[str] = []
    try:
        while (line := reader.readLine()) is not None:
            lines.append(line)
            if not isinstance(mark, str) or not mark or not line.startswith(mark):
                break
    finally:
        reader.close()
    return lines


def preamble(spark: SparkSession, path: str, sep: str = "\t", mark: str | bool = "#") -> dict:
    """The options, header names and preamble lines of a file, or of the first
    file of a folder that has a header."""
    found: dict = {"options": {}, "names": None, "preamble": []}
    for file in sorted(spark.read.text(path).inputFiles()):
        options, names, before = _head(first_lines(spark, file, mark), sep, mark)
        if names is not None:
            return {"options": options, "names": names, "preamble": before}
        found["options"] = found["options"] or options
    return found


def _variants(spark: SparkSession, files: list[str], sep: str, sep2: str, mark: str | bool) -> tuple[list[tuple], dict[str, int], dict]:
    """The distinct (names, sep, sep2) of the files, which file has which, and
    the first file's options. A file without a header takes that of the first
    file that has one; where none has, columns are numbered."""
    read = list(ThreadPool(8).imap(lambda f: first_lines(spark, f, mark), files)) if len(files) > 1 else [first_lines(spark, f, mark) for f in files]
    heads = [_head(lines, sep, mark)[:2] for lines in read]
    first = next(((o, n) for o, n in heads if n is not None), None)
    if first is None:
        options = next((o for o, _ in heads if o), {})
        row = next((lines[-1] for lines in read if lines), None)
        by = str(options.get("sep", sep))
        first = options, ["ID", *(f"F{i}" for i in range(1, len(re.split(pattern(by), row)) if row is not None else 1))]
    known: dict[tuple, int] = {}
    of_file = {}
    for file, (options, names) in zip(files, heads):
        own, named = (options, names) if names is not None else (options or first[0], first[1])
        of_file[file] = known.setdefault((tuple(named), str(own.get("sep", sep)), str(own.get("sep2", sep2))), len(known))
    return list(known), of_file, first[0]


def number(cell: Column, kind: str) -> Column:
    """The number that a cell starts with: 0 for other text, null for an empty
    or null cell."""
    pattern = r"^\s*([-+]?[0-9]+)" if kind == "long" else r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    got = F.regexp_extract(cell, pattern, 1).try_cast(kind)
    return F.when(cell != "", F.coalesce(got, F.lit(0).cast(kind)))


def open_table(
    spark: SparkSession,
    path: str,
    shape: str = "double",
    key_field: str | None = None,
    fields: list[str] | None = None,
    sep: str = "\t",
    sep2: str = "|",
    cast: str | None = None,
    how: str = "merge",
    grep: str | None = None,
    invert_grep: bool = False,
    mark: str | bool = "#",
    fixed_grep: bool = False,
    head: int | None = None,
    select: Callable[[Column], Column] | None = None,
    fix: Callable[[Column], Column] | None = None,
    spec: str | None = None,
) -> KeyedFrame:
    """``how``: merge, zipped or first, for rows that share a key. ``sep`` and
    ``sep2`` are literal, or regular expressions between slashes. ``fix``
    rewrites a line, ``select`` keeps those it holds for, ``head`` the first so
    many in file order. ``spec``: key, fields and options as text, which
    count before the arguments. ``mark``: as in ``parse_header``; lines that
    start with it are no rows.

    Every file of a folder has its own header, separators and order of columns;
    cells go to columns by name, and have no values where a file lacks the name. A
    file without a header is read by that of the first file that has one."""
    said = parse_open_string(spec) if spec else {}
    shape, key_field, fields = said.get("type", shape), said.get("key_field") or key_field, said.get("fields", fields)
    cast, how = said.get("cast", cast), "zipped" if said.get("zipped") or said.get("one2one") else "first" if said.get("merge") is False else how
    cast = {"to_i": "long", "to_f": "double"}.get(cast, cast)
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    heads, of_file, options = _variants(spark, files, sep, sep2, mark)
    if not heads:
        heads = [(("ID",), sep, sep2)]
    shape = said.get("type") or options.get("type", shape)
    names = list(dict.fromkeys(n for own, _, _ in heads for n in own))
    rows = lines.where("value <> ''").withColumns({"_file": F.input_file_name(), "_id": F.monotonically_increasing_id()})
    if isinstance(mark, str) and mark:
        rows = rows.where(~F.startswith("value", F.lit(mark)))
    elif mark is not False:
        # The first line of each file, by its place: the ids of the (few) rows
        # that read like a header.
        tops = list(dict.fromkeys(x for f in files for x in first_lines(spark, f, mark)[:1]))
        drop = rows.where(F.col("value").isin(tops)).groupBy("_file").agg(F.min("_id").alias("_id"))
        rows = rows.join(drop, ["_file", "_id"], "left_anti")
    if len(heads) == 1:
        rows = rows.withColumn("_h", F.lit(0))
    else:
        # One row for each file, as the driver has them listed.
        which = spark.createDataFrame(sorted(of_file.items()), "_file string, _h int")
        rows = rows.join(F.broadcast(which) if len(files) <= FILES else which, "_file")
    if grep:
        holds = F.col("value").contains(grep) if fixed_grep else F.col("value").rlike(grep)
        rows = rows.where(~holds if invert_grep else holds)
    if fix:
        rows = rows.withColumn("value", fix(F.col("value")))
    if select:
        rows = rows.where(F.coalesce(select(F.col("value")), F.lit(False)))
    if head is not None:
        rows = rows.orderBy("_file", "_id").limit(head)
    key = key_field or heads[0][0][0]
    own = fields or [n for n in names if n != key]
    if missing := [n for n in [key, *own] if n not in names]:
        raise KeyError(f"no field {missing} among {names}")

    def by_head(make: Callable[[tuple], object], use: Callable[[object], Column]) -> Column:
        """What ``use`` makes of each head's value; of those with equal values
        once."""
        values = [make(h) for h in heads]
        parts = {v: use(v) for v in dict.fromkeys(values)}
        if len(parts) == 1:
            return next(iter(parts.values()))
        return F.coalesce(*(F.when(F.col("_h").isin([i for i, x in enumerate(values) if x == v]), c) for v, c in parts.items()))

    parts = by_head(lambda h: h[1], lambda by: F.split("value", pattern(by), -1))
    rows = rows.select("_file", "_id", "_h", parts.alias("_p"))
    cell = lambda n: by_head(lambda h: h[0].index(n) if n in h[0] else -1, lambda i: F.get("_p", F.lit(i)) if i >= 0 else F.lit(None).cast("string"))
    split = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(by_head(lambda h: h[2], lambda by: F.split(c, pattern(by), -1)))
    order = ["_file", "_id"]
    to = (lambda c: number(c, cast)) if cast else (lambda c: c)
    if shape in ("single", "list"):
        own = own[:1] if shape == "single" else own
        t = first_wins(rows.select(*order, cell(key).alias(key), *(to(cell(f)).alias(f) for f in own)), key, own, order)
        return t.with_df(t.df, shape=shape, meta=options)
    cells = {f: F.transform(split(cell(f)), to) if cast else split(cell(f)) for f in own}
    if shape == "flat":
        rest = F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))) if not fields else F.array(*(cell(f) for f in own))
        cells, own = {own[0]: F.flatten(F.transform(rest, split))}, own[:1]
    wide = rows.select(*order, F.array_distinct(by_head(lambda h: h[2], lambda by: F.split(cell(key), pattern(by), -1))).alias(key), *(c.alias(f) for f, c in cells.items()))
    if how in ("zipped", "first"):
        t = merge_zipped(wide, key, own, order, how == "first")
    else:
        t = merge(wide.withColumn(key, F.explode(key)), key, own, order)
    return t.with_df(t.df, shape=shape, meta=options)


def open_numbers(spark: SparkSession, path: str, **options) -> KeyedFrame:
    """A table of numbers: a row for each key, each cell the number that it
    starts with, null where it is empty and 0 for other text."""
    return open_table(spark, path, shape="list", cast="double", **options)


def lines_of(t: KeyedFrame, sep: str = "\t", sep2: str = "|") -> DataFrame:
    cells = [F.array_join(F.transform(f, lambda x: x.cast("string")), sep2, "") if t.many else F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in t.fields]
    return t.df.select(F.concat_ws(sep, F.col(t.key).cast("string"), *cells).alias("value"))


def header_lines(t: KeyedFrame, sep: str = "\t") -> list[str]:
    options = {"type": t.shape} | {k: v for k, v in t.meta.items() if k != "type"}
    return [f"#: {format_options(options)}", "#" + sep.join([t.key, *t.fields])]


def write_table(t: KeyedFrame, path: str, sep: str = "\t", sep2: str = "|") -> None:
    """Text files of rows, sorted by key over all files. The header is in the
    first of them: a union keeps its sides' partitions in order, and a task
    names its file by its partition's number."""
    spark = t.df.sparkSession
    header = spark.createDataFrame([(x,) for x in header_lines(t, sep)], "value string").coalesce(1)
    header.union(lines_of(t.with_df(t.df.orderBy(t.key)), sep, sep2)).write.mode("overwrite").text(path)


def lines(t: KeyedFrame, sep: str = "\t", sep2: str = "|"):
    """Header and rows, one after the other, as they come from the tasks."""
    yield from header_lines(t, sep)
    for r in lines_of(t, sep, sep2).toLocalIterator(prefetchPartitions=True):
        yield r.value


def key_lines(t: KeyedFrame) -> DataFrame:
    """The keys, a line each."""
    return t.df.select(F.col(f"`{t.key}`").cast("string").alias("value")).where("value is not null")


def value_lines(t: KeyedFrame, fields: list[str] | None = None) -> DataFrame:
    """The values of the fields, a line each."""
    own = [t.field(f) for f in fields] if fields else t.fields
    return t.df.select(F.explode(F.concat(*(F.transform(t.values(f), lambda x: x.cast("string")) for f in own))).alias("value"))


def unmerged(t: KeyedFrame, expand: bool = False) -> KeyedFrame:
    """A row for each zipped record under its key."""
    return KeyedFrame(records(t, expand).drop("_i"), t.key, t.fields, "list")


def json_lines(t: KeyedFrame, as_records: bool = False, snake: bool = False) -> DataFrame:
    """One JSON object a row: ``{key: {field: ...}}``, or a record with the
    key as a field. ``snake``: field names in snake case."""
    plain = (lambda n: re.sub(r"[\s-]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", n))).lower()) if snake else (lambda n: n)
    cells = [F.col(f"`{f}`").alias(plain(f)) for f in t.fields]
    options = {"ignoreNullFields": "false"}
    if as_records:
        return t.df.select(F.to_json(F.struct(F.col(f"`{t.key}`").alias(plain(t.key)), *cells), options).alias("value"))
    return t.df.select(F.to_json(F.create_map(F.col(f"`{t.key}`").cast("string"), F.struct(*cells)), options).alias("value"))


def info(t: KeyedFrame) -> dict:
    """Key, fields, shape, options and the number of rows."""
    return {"key": t.key, "fields": list(t.fields), "shape": t.shape, "options": dict(t.meta), "rows": t.df.count()}


def record(t: KeyedFrame, key, digits: int | None = None) -> DataFrame:
    """The row of a key, numbers rounded to so many digits."""
    own = t.df.where(F.col(f"`{t.key}`") == key)
    kinds = dict(own.dtypes)
    return own.withColumns({f: F.round(F.col(f"`{f}`"), digits) for f in t.fields if kinds[f] in ("double", "float")}) if digits is not None else own


def read_csv(spark: SparkSession, path: str, header: bool = True, shape: str = "list", key_field: str | None = None, fields: list[str] | None = None, cast: str | None = None, how: str = "first", **options) -> KeyedFrame:
    """The first column is the key, or ``key_field``; without a header the keys
    are ``row-0``, ``row-1``, ... in file order. Rows that share a key:
    ``how`` as in ``open_table``, for shape double; else the first stays."""
    df = spark.read.csv(path, header=header, multiLine=True, escape='"', **options)
    order = ["_file", "_id"]
    df = df.withColumns({"_file": F.input_file_name(), "_id": F.monotonically_increasing_id()})
    names = [c for c in df.columns if c not in order]
    if not header:
        df = numbered(df, order).withColumn("key", F.concat(F.lit("row-"), (F.col("_n") - 1).cast("string"))).drop("_n")
    key = key_field or ("key" if not header else names[0])
    own = fields or [n for n in names if n != key]
    to = (lambda c: number(c, cast)) if cast else (lambda c: c)
    rows = df.select(*order, F.col(f"`{key}`").alias(key), *(to(F.col(f"`{f}`")).alias(f) for f in own))
    t = merge(rows, key, own, order) if shape == "double" and how == "merge" else first_wins(rows, key, own, order)
    if shape == "double" and how != "merge":
        t = to_double(t)
    return t.with_df(t.df, shape=shape, meta={})


def through_pandas(t: KeyedFrame, change: Callable, schema) -> KeyedFrame:
    """The table by way of pandas: ``change`` gets batches of rows as a frame
    whose index is the key, inside the tasks, and gives one of the same kind.
    ``schema``: of key and fields then."""

    key = t.key

    def run(batches):
        for batch in batches:
            yield change(batch.set_index(key)).rename_axis(key).reset_index()

    made = t.df.mapInPandas(run, schema)
    return KeyedFrame(made, t.key, [c for c in made.columns if c != t.key], t.shape)


def to_pandas(t: KeyedFrame):
    """The whole table as a frame of the driver, with the key as its index."""
    return t.df.toPandas().set_index(t.key)


def from_pandas(spark: SparkSession, frame, key: str | None = None) -> KeyedFrame:
    """A frame of the driver, whose index is the key."""
    name = key or frame.index.name or "ID"
    return keyed(spark.createDataFrame(frame.rename_axis(name).reset_index()), name)


def open_source(spark: SparkSession, source, **options) -> KeyedFrame:
    """A keyed table from whatever it is: a keyed table, a frame (its first
    column is the key), a dict, a list of keys, or a path (by its ending:
    Parquet, CSV or JSON, else text, also compressed)."""
    if isinstance(source, KeyedFrame):
        return source
    if isinstance(source, DataFrame):
        return keyed(source, options.pop("key_field", source.columns[0]), **options)
    if isinstance(source, dict):
        key, fields = options.get("key_field", "ID"), options.get("fields")
        rows = [(k, *(v if isinstance(v, (list, tuple)) else [v])) for k, v in source.items()]
        fields = fields or [f"F{i}" for i in range(1, len(rows[0]))]
        many = bool(rows) and isinstance(rows[0][1], (list, tuple))
        return KeyedFrame(spark.createDataFrame(rows, [key, *fields]), key, list(fields), "double" if many else "list")
    if isinstance(source, (list, tuple, set)):
        return KeyedFrame(spark.createDataFrame([(x,) for x in source], [options.get("key_field", "ID")]), options.get("key_field", "ID"), [], "list")
    plain = re.sub(r"\.(gz|bz2|zst|snappy|lz4)$", "", str(source).rstrip("/"))
    if plain.endswith(".parquet"):
        df = spark.read.parquet(source)
        return keyed(df, options.pop("key_field", df.columns[0]), **options)
    if plain.endswith((".json", ".jsonl")):
        df = spark.read.json(source)
        return keyed(df, options.pop("key_field", df.columns[0]), **options)
    if plain.endswith(".csv"):
        return read_csv(spark, source, **options)
    return open_table(spark, source, **options)


#: How a stored result of each kind is read and written.
KINDS = ("tsv", "csv", "json", "parquet", "text", "binary", "list", "integer", "float", "boolean", "string")


def load_result(spark: SparkSession, path: str, kind: str):
    """A stored result: a keyed table or frame, or for ``list``, a frame of
    lines; ``integer``, ``float``, ``boolean`` and ``string`` are values."""
    if kind in ("tsv", "csv"):
        return open_table(spark, path) if kind == "tsv" else read_csv(spark, path)
    if kind in ("integer", "float", "boolean", "string"):
        # Whole files, without the newline that ends the last line of each.
        parts = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name()).orderBy("_file").collect()
        text = "\n".join(r.value.removesuffix("\n") for r in parts)
        return {"integer": int, "float": float, "boolean": lambda x: x.strip() == "true", "string": str}[kind](text)
    if kind == "binary":
        return spark.read.format("binaryFile").load(path).select("path", "content")
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return getattr(spark.read, "text" if kind == "list" else kind)(path)


def save_result(spark: SparkSession, path: str, kind: str, content) -> None:
    """The inverse; Spark's committer shows a result only when it is whole."""
    if kind == "tsv":
        write_table(content, path)
    elif kind in ("integer", "float", "boolean", "string"):
        shown = str(content).lower() if kind == "boolean" else str(content)
        spark.createDataFrame([(shown,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif kind in KINDS and kind != "binary":
        getattr(content.write.mode("overwrite"), "text" if kind == "list" else kind)(path)
    else:
        raise ValueError(f"{kind} can't be written")
