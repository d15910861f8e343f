"""ARFF files: relations as text with a typed header."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.model import NOMINAL, NUMERIC, STRING, Attribute, Relation, Sparse

MISSING = ("?", "<null>")
#: A field: in double quotes, in single quotes, or plain up to the comma.
FIELD = r"""\s*("(?:[^"]|"")*"|'(?:[^'\\]|\\.)*'|[^,]*?)\s*,"""
NUMERIC_TYPES = ("numeric", "real", "integer")


def parse_labels(text: str) -> tuple[str, ...]:
    """Labels between braces: quoted ones keep their spaces, others lose them."""
    out = []
    for quoted, plain in re.findall(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([^,]*))\s*(?:,|$)""", text):
        if quoted:
            out.append(re.sub(r"\\(.)", r"\1", quoted[1:-1]))
        elif plain.strip():
            out.append(plain.replace(" ", ""))
    return tuple(out)


def parse_attribute(line: str) -> Attribute:
    """One ``@attribute`` line; names are lower-cased, labels are not."""
    rest = re.sub(r"(?i)^\s*@attribute\s+", "", line).strip()
    m = re.match(r"""("[^"]*"|'[^']*'|[^\s{]+)\s*(.*)$""", rest)
    if not m:
        raise ValueError(f"no attribute name in {line!r}")
    name, kind = m[1].strip("\"'").lower(), m[2].strip()
    if not kind:
        raise ValueError(f"attribute {name!r} has no type")
    if "{" in kind and "}" in kind:
        return Attribute(name, NOMINAL, parse_labels(kind[kind.index("{") + 1 : kind.rindex("}")]))
    word = kind.split()[0].split("[")[0].lower()
    if word in NUMERIC_TYPES:
        bounds = None
        if b := re.search(r"\[([^,\]]*),([^\]]*)\]", kind):
            try:
                bounds = (float(b[1]), float(b[2]))
            except ValueError:
                raise ValueError(f"bad bounds in {line!r}") from None
        return Attribute(name, NUMERIC, bounds=bounds)
    if word == "string":
        return Attribute(name, STRING)
    raise ValueError(f"unsupported attribute type {word!r} in {line!r}")


def parse_header(lines: list[str]) -> tuple[str, tuple[Attribute, ...]]:
    """Relation name and attributes of the lines before ``@data``."""
    name, attributes = "", []
    for line in lines:
        word = line.strip().lower()
        if word.startswith("@data"):
            break
        if word.startswith("@relation"):
            name = line.strip()[len("@relation") :].strip().strip("\"'")
        elif word.startswith("@attribute"):
            attributes.append(parse_attribute(line))
    return name, tuple(attributes)


def read_header(spark: SparkSession, path: str, step: int = 1000) -> tuple[str, tuple[Attribute, ...]]:
    """The header of a file or folder. Usually it is at the head of what is read,
    and no more is read than needed; where Spark reads another part file first,
    the header's lines are looked for in all of them."""
    text = spark.read.text(path)
    mark = r"(?i)^\s*@(relation|attribute|data)\b"
    n = step
    while True:
        lines = [r[0] for r in text.take(n)]
        first = next((x for x in lines if x.strip() and not x.lstrip().startswith("%")), "")
        if not re.match(mark, first):
            break
        if any(re.match(r"(?i)^\s*@data\b", x) for x in lines):
            return parse_header(lines)
        if len(lines) < n:
            raise ValueError(f"no @data section in {path}")
        n *= 8
    order = text.select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = [r[0] for r in order.where(F.col("value").rlike(mark)).orderBy("file", "at").select("value").collect()]  # a line per attribute
    if not lines:
        raise ValueError(f"no header in {path}")
    return parse_header(lines)


def read_arff(spark: SparkSession, path: str, class_name: str | int | None = None, strict: bool = False) -> Relation:
    """A relation from ARFF files of one header: dense and sparse rows, comments
    and blank lines anywhere. ``?`` and ``<null>`` are missing. Undeclared labels
    and bad numbers are missing too, or an error at run time if ``strict``. Rows
    are numbered in ``row_id`` (unique, not consecutive)."""
    name, attributes = read_header(spark, path)
    line = F.trim("value")
    data = spark.read.text(path).select(F.regexp_replace("value", r"^[\s]+|[\s]+$", "").alias("value"))
    data = data.where((line != "") & ~line.startswith("%") & ~F.lower(line).rlike(r"^@(relation|attribute|data)\b"))
    data = data.withColumn("row_id", F.monotonically_increasing_id())
    fields = F.regexp_extract_all(F.concat("value", F.lit(",")), F.lit(FIELD), 1)
    pairs = F.regexp_extract_all(F.concat(F.regexp_replace("value", r"^\{|\}$", ""), F.lit(",")), F.lit(FIELD), 1)
    pairs = F.filter(pairs, lambda p: p != "")
    stored = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_replace(p, r"^\d+\s+", ""))))
    data = data.select("row_id", F.col("value").startswith("{").alias("is_sparse"), F.when(~F.col("value").startswith("{"), fields).alias("f"), F.when(F.col("value").startswith("{"), stored).alias("m"))
    columns = []
    for i, a in enumerate(attributes):
        absent = {NUMERIC: "0", NOMINAL: a.labels[0] if a.labels else "", STRING: ""}[a.kind]
        raw = F.when(F.col("is_sparse"), F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(absent))).otherwise(F.try_element_at("f", F.lit(i + 1)))
        columns.append(_typed(raw, a, strict).alias(a.name))
    if isinstance(class_name, int):
        class_name = attributes[class_name].name
    return Relation(name, attributes, data.select("row_id", *columns), class_name)


def _typed(raw: Column, a: Attribute, strict: bool) -> Column:
    single = raw.startswith("'")
    text = F.when(single, F.regexp_replace(F.regexp_replace(raw, r"^'+|'+$", ""), r"\\(.)", "$1")).when(
        raw.startswith('"'), F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), '""', '"')
    ).otherwise(raw)
    missing = F.lower(raw).isin(*MISSING) | raw.isNull()
    if a.is_numeric:
        value = text.try_cast("double")
        bad = value.isNull()
    elif a.is_nominal:
        value, bad = F.when(text.isin(*a.labels), text) if a.labels else F.lit(None).cast("string"), ~text.isin(*a.labels)
    else:
        value, bad = text, F.lit(False)
    if strict:
        value = F.when(~bad, value).otherwise(F.raise_error(F.concat(F.lit(f"bad value of {a.name}: "), text)))
    return F.when(~missing, value)


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'" if re.search(r"[\s,{}%'\"?\\]", text) or not text else text


def quoted(value: Column) -> Column:
    safe = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(value, r"([\\'])", r"\\$1"), r"[\r\n]+", " "), F.lit("'"))
    return F.when(value.rlike(r"""[\s,{}%'"?\\]""") | (value == ""), safe).otherwise(value)


def header_lines(name: str, attributes) -> list[str]:
    out = [f"@relation {quote(name)}", ""]
    for a in attributes:
        if a.is_nominal:
            kind = "{" + ",".join(quote(x) for x in a.labels) + "}"
        elif a.is_string:
            kind = "string"
        else:
            kind = "numeric" + (f" [{a.bounds[0]:g},{a.bounds[1]:g}]" if a.bounds else "")
        out.append(f"@attribute {quote(a.name)} {kind}")
    return [*out, "", "@data"]


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction, others in full."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def dense_lines(data: Relation) -> DataFrame:
    """``row_id, line``: the data rows of a dense file."""
    cells = []
    for a in data.attributes:
        c = F.col(f"`{a.name}`")
        cells.append(F.coalesce(number_text(c.cast("double")) if a.is_numeric else quoted(c.cast("string")), F.lit("?")))
    return data.frame.select(F.col(f"`{data.row_id}`").alias("row_id"), F.concat_ws(",", *cells).alias("line"))


def sparse_lines(data: Sparse) -> DataFrame:
    """``row_id, line``: the data rows of a sparse file; a row without entries is ``{}``."""
    nominal = [(i, float(j), quote(x)) for i, a in enumerate(data.attributes) if a.is_nominal for j, x in enumerate(a.labels)]
    spark = data.entries.sparkSession
    labels = spark.createDataFrame(nominal or [(-1, 0.0, "")], "attr_idx int, value double, label string")
    each = data.entries.join(F.broadcast(labels), ["attr_idx", "value"], "left").where("value IS NULL OR value <> 0")
    text = F.concat(F.col("attr_idx").cast("string"), F.lit(" "), F.coalesce("label", number_text(F.col("value")), F.lit("?")))
    packed = each.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("attr_idx", text.alias("t")))).alias("cells"))
    line = F.concat(F.lit("{"), F.array_join(F.transform("cells", lambda c: c["t"]), ","), F.lit("}"))
    return data.rows.select("row_id").join(packed, "row_id", "left").select("row_id", F.coalesce(line, F.lit("{}")).alias("line"))


def sparse_header(data: Sparse) -> DataFrame:
    """``pos, line``: the header, its word attributes taken from the vocabulary table."""
    spark = data.entries.sparkSession
    own = header_lines(data.name, data.attributes)[:-2]
    head = spark.createDataFrame([(float(i - len(own)), x) for i, x in enumerate(own)], "pos double, line string")
    if data.words is not None:
        head = head.union(data.words.select(F.col("attr_idx").cast("double"), F.concat(F.lit("@attribute "), quoted(F.col("word")), F.lit(" numeric"))))
    return head.union(spark.createDataFrame([(float("inf"), "@data")], "pos double, line string"))


def write_lines(head: DataFrame, rows: DataFrame, path: str) -> None:
    """Write a header (``pos, line``) and rows (``line``) as text part files: the
    first holds the header, so the files in order of their names are one ARFF."""
    head.coalesce(1).sortWithinPartitions("pos").select("line").union(rows.select("line")).write.text(path)


def write_dense(data: Relation, path: str) -> None:
    spark = data.frame.sparkSession
    head = spark.createDataFrame([(float(i), x) for i, x in enumerate(header_lines(data.name, data.attributes))], "pos double, line string")
    write_lines(head, dense_lines(data), path)


def write_sparse(data: Sparse, path: str) -> None:
    write_lines(sparse_header(data), sparse_lines(data), path)
