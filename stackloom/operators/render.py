"""Text forms of results. Lines are made by Spark; putting them in one file is left to the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import text
from ..plans.session import checkpointed
from . import lattice

LABEL = 40
ROOT_NAME = "root function"


def named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """columns (`function` if none is given) as names where names (function, name) has one, else as numbers; 0 is the root.

    Arrays, as paths are, become arrays of names.
    """
    for column in columns or ("function",):
        if df.schema[column].dataType.typeName() == "array":
            rows = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
            each = named(rows.select("__row", F.posexplode(column).alias("__i", "__x")), names, "__x")
            whole = each.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda v: v["__x"]).alias("__names"))
            df = rows.join(whole, "__row", "left").withColumn(column, F.coalesce("__names", F.array().cast("array<string>"))).drop("__row", "__names")
            continue
        known = names.select(F.col("function").alias("__f"), F.col("name").alias("__n"))
        shown = F.when(F.col(column) == 0, ROOT_NAME).otherwise(F.coalesce("__n", F.col(column).cast("string")))
        df = df.join(known, F.col(column) == F.col("__f"), "left").withColumn(column, shown).drop("__f", "__n")
    return df


def call_list_lines(stats: DataFrame) -> DataFrame:
    """process, function, line, in printing order."""
    line = F.concat(F.lit("  "), F.col("function").cast("string"), F.lit(": "), F.col("invocations").cast("string"), F.lit(" exclusive "), text("exc"), F.lit(" inclusive "), text("inc"))
    return stats.select("process", "function", line.alias("line")).orderBy("process", "function")


def call_matrix_lines(stats: DataFrame) -> DataFrame:
    caller = F.when(F.col("caller").cast("string") == "0", ROOT_NAME).otherwise(F.col("caller").cast("string"))
    line = F.concat(F.lit("  "), caller, F.lit(" -> "), F.col("function").cast("string"), F.lit(": "), F.col("invocations").cast("string"), F.lit(" exclusive "), text("exc"), F.lit(" inclusive "), text("inc"))
    return stats.select("process", "caller", "function", line.alias("line")).orderBy("process", "caller", "function")


def call_tree_lines(stats: DataFrame) -> DataFrame:
    """One line a node, indented by its depth; path is an array."""
    line = F.concat(F.expr("repeat('\t', size(path))"), F.element_at("path", -1).cast("string"), F.lit(": "), F.col("invocations").cast("string"))
    return stats.select("process", "path", line.alias("line")).orderBy("process", "path")


def profile_lines(stats: DataFrame, keys: list[str], measure: str, width: int = 14) -> DataFrame:
    """Aligned percentiles and sum of one measure by key, pairs and paths as `a -> b`."""
    parts = [F.concat_ws(" -> ", F.col(k)) if dict(stats.dtypes)[k].startswith("array") else F.col(k).cast("string") for k in keys]
    cells = [F.lpad(F.col(f"{measure}.{f}").cast("string"), width, " ") for f in ("p2", "p25", "median", "p75", "p98", "accumulated")]
    return stats.select(*keys, F.concat_ws(" ", F.concat_ws(" -> ", *parts), *cells).alias("line")).orderBy(*keys)


def profile_header(width: int = 14) -> str:
    """Above `profile_lines`."""
    return " ".join(["identifier", *(c.rjust(width) for c in ("2 %", "25 %", "50 %", "75 %", "98 %", "accumulated"))])


def cut_label(label: Column) -> Column:
    return F.when(F.length(label) > LABEL, F.concat(F.substring(label, 1, LABEL), F.lit("..."))).otherwise(label)


def _escaped(label: Column) -> Column:
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(">"), F.lit("&gt;"))


def attribute(x: Column, kind: str) -> Column:
    """An attribute as text: pairs as `a -> b`."""
    return F.concat_ws(" -> ", x["from"].cast("string"), x["to"].cast("string")) if kind.startswith("struct") else x.cast("string")


def lattice_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, line: a Graphviz digraph from subsets to supersets, labels cut after 40 characters."""
    kind = nodes.schema["reduced"].dataType.elementType.simpleString()
    label = cut_label(F.array_join(F.transform("reduced", lambda x: attribute(x, kind)), ", "))
    owners = cut_label(F.array_join(F.col("objects").cast("array<string>"), ", "))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    short = lambda c: F.substring(c, 1, 12)
    box = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), quote(short("node")), F.lit(" [label="), quote(F.concat(_escaped(label), F.lit("\\n"), owners)), F.lit("];")).alias("line"))
    arrow = edges.select(F.lit(2).alias("ord"), F.concat(F.lit("  "), quote(short("lower")), F.lit(" -> "), quote(short("upper")), F.lit(";")).alias("line"))
    spark = nodes.sparkSession
    return spark.createDataFrame([(0, "digraph {"), (3, "}")], "ord int, line string").unionByName(box).unionByName(arrow).orderBy("ord", "line")


def tree_dot(paths: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """ord, line: call trees as a digraph, one root a process; with names, labels are `id: name`."""
    at = lambda p: F.concat(F.lit('"'), F.col("process").cast("string"), F.lit("/"), F.concat_ws("/", p.cast("array<string>")), F.lit('"'))
    own = paths.select("process", "path").distinct()
    path = F.col("path")
    label = F.element_at("path", -1).cast("string")
    boxes = own.withColumn("label", label)
    if names is not None:
        known = names.select(F.col("function").cast("string").alias("label"), F.col("name").alias("of"))
        boxes = boxes.join(known, "label", "left").withColumn("label", F.when(F.col("of").isNotNull(), F.concat("label", F.lit(": "), _escaped(F.col("of")))).otherwise(F.col("label")))
    box = boxes.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), at(path), F.lit(' [label="'), "label", F.lit('"];')).alias("line"))
    arrow = own.select(F.lit(2).alias("ord"), F.concat(F.lit("  "), at(F.slice("path", 1, F.size("path") - 1)), F.lit(" -> "), at(path), F.lit(";")).alias("line"))
    return paths.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "ord int, line string").unionByName(box).unionByName(arrow).orderBy("ord", "line")


def cross_table(context: DataFrame) -> DataFrame:
    """object, crosses: one X or dot for each attribute in order."""
    attrs = context.select("attr").distinct().agg(F.sort_array(F.collect_list("attr")).alias("attrs"))
    owned = context.groupBy("object").agg(F.collect_set("attr").alias("own"))
    crosses = F.array_join(F.transform("attrs", lambda a: F.when(F.array_contains("own", a), "X").otherwise(".")), "")
    return owned.crossJoin(F.broadcast(attrs)).select("object", crosses.alias("crosses"))


def cxt(context: DataFrame) -> str:
    """A Burmeister context, for contexts that fit the driver as text."""
    kind = context.schema["attr"].dataType.simpleString()
    rows = cross_table(context).orderBy("object").collect()
    attrs = [r[0] for r in context.select("attr").distinct().orderBy("attr").select(attribute(F.col("attr"), kind)).collect()]
    return "\n".join(["B", "", str(len(rows)), str(len(attrs)), "", *[str(r.object) for r in rows], *attrs, *[r.crosses for r in rows], ""])


def lattice_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By node: reduced attributes, own objects, all objects of the node and of those above it, direct neighbours."""
    up = edges.groupBy(F.col("lower").alias("node")).agg(F.sort_array(F.collect_list("upper")).alias("supersets"))
    down = edges.groupBy(F.col("upper").alias("node")).agg(F.sort_array(F.collect_list("lower")).alias("subsets"))
    every = lattice.all_objects(nodes).groupBy("node").agg(F.sort_array(F.collect_set("object")).alias("all_objects"))
    rows = nodes.join(up, "node", "left").join(down, "node", "left").join(every, "node", "left")
    return rows.select("node", "reduced", "objects", "all_objects", "subsets", "supersets", "is_min", "is_max").orderBy("node")


def lattice_text(lines: DataFrame, kind: str) -> DataFrame:
    """node, line: a block of text for each row of `lattice_lines`; kind: the type of an attribute."""
    shown = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\t{label}: "), F.array_join(F.col(c).cast("array<string>"), ", ")))
    attrs = F.when(F.size("reduced") > 0, F.concat(F.lit("\n\tattributes ("), F.size("reduced").cast("string"), F.lit("): "), F.array_join(F.transform("reduced", lambda x: attribute(x, kind)), ", ")))
    parts = [shown("objects", "direct objects"), shown("all_objects", "all objects"), shown("subsets", "direct subsets"), shown("supersets", "direct supersets"), attrs]
    ends = F.concat(F.when(F.col("is_min"), " min").otherwise(""), F.when(F.col("is_max"), " max").otherwise(""))
    return lines.select("node", F.concat("node", ends, F.lit(" {"), F.concat_ws("", *parts), F.lit("\n}")).alias("line")).orderBy("node")


def group_lines(groups: DataFrame) -> DataFrame:
    """number, line: equality groups (intent, objects, first), numbered in order of their least object."""
    number = F.row_number().over(Window.orderBy("first"))
    return groups.select(number.alias("number"), F.concat(F.lpad(number.cast("string"), 3, " "), F.lit(": "), F.array_join(F.col("objects").cast("array<string>"), ", ")).alias("line")).orderBy("number")


def tree_diff_lines(diff: DataFrame) -> DataFrame:
    """p, q, line: a line a node, indented by its depth in the difference."""
    rows = diff.select("p", "q", F.explode("rows").alias("r")).select("p", "q", "r.*")
    mark = F.when(F.col("op") == -1, "-").when(F.col("op") == 0, "=").otherwise("+")
    line = F.concat(F.repeat(F.lit("\t"), F.size("pos_path") - 1), mark, F.col("function").cast("string"))
    return rows.orderBy("p", "q", "pos_path").select("p", "q", line.alias("line"))


def anchors(column: str) -> Column:
    """Anchors as text: (0, 0), (2, 3)."""
    return F.array_join(F.transform(column, lambda x: F.concat(F.lit("("), x["p"].cast("string"), F.lit(", "), x["q"].cast("string"), F.lit(")"))), ", ")


def unifier_lines(names: DataFrame, unifier: DataFrame) -> DataFrame:
    """ord, line: the unified names, then each trace's tokens."""
    pairs = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: F.concat(x[a].cast("string"), F.lit(" : "), x[b].cast("string"))), ", ")
    functions = names.agg(F.lit(0).alias("ord"), F.concat(F.lit("functions: { "), pairs("function", "name"), F.lit(" }")).alias("line"))
    traces = unifier.groupBy("trace_id").agg(F.concat(F.lit("trace "), F.first(F.col("trace_id").cast("string")), F.lit(": { "), pairs("token", "function"), F.lit(" }")).alias("line"))
    return functions.unionByName(traces.select(F.col("trace_id").alias("ord"), "line")).orderBy("ord")


def checksum(data: bytes) -> int:
    """CRC-16 of ISO 3309, reflected, as X.25 uses it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x8408 if crc & 1 else 0)
    return crc ^ 0xFFFF


def colours(names: DataFrame) -> DataFrame:
    """function, r, g, b: of a name, its double and its triple, by checksum. names is a dictionary of functions."""
    rows = [(r.function, *(checksum((r.name * k).encode()) % 255 for k in (1, 2, 3))) for r in names.select("function", "name").collect()]
    return names.sparkSession.createDataFrame(rows, "function int, r int, g int, b int")


def similarity_lines(values: DataFrame) -> DataFrame:
    """p, line: a row of the matrix with two decimals."""
    cell = F.format_number("value", 2)
    return values.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", cell.alias("v")))), lambda x: x.v), " ").alias("line")).orderBy("p")


def ops(column: str) -> Column:
    """Differences as text: -1,2 =3 +4."""
    mark = lambda o: F.when(o == -1, "-").when(o == 0, "=").otherwise("+")
    return F.array_join(F.transform(column, lambda x: F.concat(mark(x["op"]), F.array_join(x["seq"].cast("array<string>"), ","))), " ")


def rectangles(calls: DataFrame) -> DataFrame:
    """process, call_id, function, level, width and middle of every call, relative to its process's span."""
    whole = Window.partitionBy("process")
    start, span = F.min("t_begin").over(whole), F.max("t_end").over(whole) - F.min("t_begin").over(whole)
    placed = calls.withColumn("start", start).withColumn("span", span)
    width = F.when(F.col("span") > 0, F.col("inclusive") / F.col("span")).otherwise(1.0)
    middle = F.when(F.col("span") > 0, ((F.col("t_begin") - F.col("start")) + F.col("inclusive") / 2.0) / F.col("span")).otherwise(0.5)
    return placed.select("process", "call_id", "function", F.col("depth").alias("level"), F.round(width, 9).alias("width"), F.round(middle, 9).alias("middle"))


def tikz(rects: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """ord, process, call_id, line: colour definitions of the named functions, then one TikZ node a call, filled with its function's colour."""
    number = lambda c: F.format_string("%.6f", F.col(c))
    fill = F.concat(F.lit(", fill="), F.col("function").cast("string")) if names is not None else F.lit("")
    line = F.concat(F.lit("\\node[call"), fill, F.lit(", minimum width="), number("width"), F.lit("\\linewidth] at ("), number("middle"), F.lit(","), F.col("level").cast("string"), F.lit(") {};"))
    nodes = rects.select(F.lit(1).alias("ord"), "process", "call_id", line.alias("line"))
    if names is not None:
        defined = F.concat(F.lit("\\definecolor{"), F.col("function").cast("string"), F.lit("}{RGB}{"), F.concat_ws(",", F.col("r").cast("string"), F.col("g").cast("string"), F.col("b").cast("string")), F.lit("}"))
        nodes = nodes.unionByName(colours(names).select(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("process"), F.col("function").cast("long").alias("call_id"), defined.alias("line")))
    return nodes.orderBy("ord", "process", "call_id")


def boxes(stats: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """keys and a box plot of a measure: whiskers at 2 and 98 %, box from 25 to 75 %, line at 50 %, as shares of the largest 98 % point."""
    own = checkpointed(stats.select(*keys, measure))
    wide = own.withColumn("top", F.lit(own.agg(F.max(f"{measure}.p98")).first()[0]))
    part = lambda p: F.round(F.when(F.col("top") > 0, F.col(f"{measure}.{p}") / F.col("top")).otherwise(0.0), 9)
    return wide.select(*keys, part("p2").alias("low"), part("p25").alias("box_low"), part("median").alias("line"), part("p75").alias("box_high"), part("p98").alias("high"))
