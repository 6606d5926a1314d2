"""Code facts: headerless CSV files by kind, and their extraction from disassembly text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.expr import any_of, file_path
from codelode.plans.storage import written
from codelode.schema import DISTINCT_FACTS, FACTS, FLAGS, READ, WRITE

# Prefixes of classes, and parts of file paths, of bundled libraries.
LIBRARY_CLASSES = ("Landroidx/", "Landroid/support/", "Landroid/material/", "Lkotlin/")
LIBRARY_FILES = ("androidx/", "android/support/", "android/material/", "kotlin/", "javax/")
OBJECT = "Ljava/lang/Object;"

_CSV = {"header": False, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST", "nullValue": "\x00", "emptyValue": ""}


def read_fact_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Facts of one kind; a row of another width or with a wrong number fails the read. Empty text stays empty."""
    return spark.read.schema(FACTS[kind]).options(**_CSV).csv(f"{path}/{kind}.csv").na.fill("")


def write_fact_csv(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    rows = df.select(*FACTS[kind].names)
    rows = rows.dropDuplicates() if kind in DISTINCT_FACTS else rows
    rows.write.mode(mode).options(**{k: v for k, v in _CSV.items() if k != "mode"}, quoteAll=True).csv(f"{path}/{kind}.csv")


def write_facts(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Facts with a source column as Parquet, a folder for each source."""
    rows = df.select("source", *FACTS[kind].names)
    (rows.dropDuplicates() if kind in DISTINCT_FACTS else rows).write.mode(mode).partitionBy("source").parquet(f"{path}/{kind}")


def is_library_class(c: Column) -> Column:
    return any_of(*(c.startswith(p) for p in LIBRARY_CLASSES))


def is_library_file(path: Column) -> Column:
    return any_of(*(path.contains(p) for p in LIBRARY_FILES))


def ignore_library_classes(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts about and calls into library classes go, as do the root class as a parent and calls of its constructor. Names of parents and interfaces stay."""
    own = {"classes": "class", "supers": "child", "interfaces": "class", "class_fields": "class", "methods": "class", "calls": "caller_class", "method_field_access": "method_class", "method_strings": "class"}
    out = {k: df.where(~is_library_class(F.col(own[k]))) if k in own else df for k, df in facts.items()}
    if "supers" in out:
        out["supers"] = out["supers"].where(F.col("parent") != OBJECT)
    if "calls" in out:
        out["calls"] = out["calls"].where(~is_library_class(F.col("callee_class")) & ~((F.col("callee_class") == OBJECT) & (F.col("callee_name") == "<init>")))
    if "method_field_access" in out:
        out["method_field_access"] = out["method_field_access"].where(~is_library_class(F.col("field_class")))
    return out


def read_disassembly(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(path, source, text): one row for each disassembly file, library files left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.smali").text(path, wholetext=True)
    return files.select(file_path(F.input_file_name()).alias("path"), F.lit(source).alias("source"), F.col("value").alias("text")).where(~is_library_file(F.col("path")))


_DIRECTIVES = {
    "class": "^\\s*\\.class\\s+(.*)$",
    "super": "^\\s*\\.super\\s+(\\S+)",
    "implements": "^\\s*\\.implements\\s+(\\S+)",
    "field": "^\\s*\\.field\\s+(.*)$",
    "method": "^\\s*\\.method\\s+(.*)$",
}
_CALL = "^\\s*invoke-\\S+\\s+\\{[^}]*\\},\\s*(\\[*[^\\s;]+;?)->([^(\\s]+)\\(([^)]*)\\)"
_FIELD = "^\\s*[is](get|put)\\S*\\s+[^\\s]+(?:,\\s*[vp]\\d+)?,\\s*([^\\s;]+;)->([^:\\s]+):(\\S+)"
_INNER = '[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+'  # of a string literal
_LITERAL = f'"{_INNER}"'
_STRING = f'^\\s*const-string\\S*\\s+[vp]\\d+,\\s*"({_INNER})"\\s*(?:#.*)?$'
_FIELD_STRING = f'=\\s*"({_INNER})"\\s*(?:#.*)?$'
_HEAD = "^\\s*\\.(?:class|method)\\s"


def disassembly_lines(text: DataFrame) -> DataFrame:
    """(path, source, line, value, class, method, args, ret): every line, with the class and the last method header at or above it.

    A method's context lasts to the next header. A file is cut at its headers within its own row, so lines get their context without a
    shuffle; a file is as large as its text, and each of its blocks is a row before its lines are."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("head"))
    marked = F.filter(F.transform("__lines", lambda v, i: F.struct(i.alias("at"), v.alias("head"))), lambda x: x["head"].rlike(_HEAD))
    name = lambda x: F.when(x["head"].rlike(_DIRECTIVES["class"]), F.regexp_extract(x["head"], "(\\S+)\\s*$", 1))
    header = lambda x: F.when(x["head"].rlike(_DIRECTIVES["method"]), F.regexp_extract(x["head"], "(\\S+)\\(([^)]*)\\)(\\S+)\\s*$", 0))
    rows = text.select("path", "source", F.split("text", "\r?\n").alias("__lines"))
    rows = rows.select("path", "source", "__lines", F.concat(F.array(none), marked).alias("__heads"))
    rows = rows.select("*", F.transform("__heads", name).alias("__names"), F.transform("__heads", header).alias("__methods"))
    rows = rows.select("*", F.size(F.array_compact("__names")).alias("__classes"), (F.array_position(F.transform("__names", lambda x: x.isNotNull()), True) - 1).alias("__first"))
    latest = lambda c, k: F.try_element_at(F.array_compact(F.slice(c, F.lit(1), k + 1)), F.lit(-1))

    def block(h: Column, k: Column) -> Column:
        to = F.coalesce(F.get("__heads", k + 1)["at"], F.size("__lines"))
        of = F.when(F.col("__classes") > 1, latest("__names", k)).when((F.col("__classes") == 1) & (k >= F.col("__first")), F.get("__names", F.col("__first").cast("int")))
        return F.struct(h["at"].alias("at"), F.slice("__lines", h["at"] + 1, to - h["at"]).alias("lines"), of.alias("class"), F.coalesce(F.get("__methods", k), latest("__methods", k)).alias("header"))

    blocks = rows.select("path", "source", F.explode(F.transform("__heads", block)).alias("b"))
    lines = blocks.select("path", "source", "b.class", "b.header", "b.at", F.posexplode("b.lines").alias("n", "value"))
    parts = {"method": 1, "args": 2, "ret": 3}
    return lines.select("path", "source", (F.col("at") + F.col("n")).alias("line"), "value", "class", *(F.regexp_extract("header", "^([^(]+)\\(([^)]*)\\)(.*)$", i).alias(n) for n, i in parts.items()))


def _flags(words: Column) -> Column:
    """The bits of the flag names among the words before a name."""
    bits = F.create_map(*(F.lit(x) for name, bit in FLAGS.items() for x in (name.lower(), bit)))
    known = F.filter(F.transform(F.split(words, "\\s+"), lambda w: F.coalesce(bits[w], F.lit(0))), lambda b: b > 0)
    return F.aggregate(known, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b.cast("long")))


def tagged_lines(text: DataFrame) -> DataFrame:
    """disassembly_lines that hold some fact, with `kind`: that of its directive, or call, access or string."""
    test = {**_DIRECTIVES, "call": _CALL, "access": _FIELD, "string": _STRING}
    kind = F.coalesce(*(F.when(F.col("value").rlike(pattern), F.lit(k)) for k, pattern in test.items()))
    lines = disassembly_lines(text).where(~is_library_class(F.coalesce("class", F.lit("")))).withColumn("kind", kind)
    return lines.where("kind is not null")


def extract_code_facts(text: DataFrame) -> dict[str, DataFrame]:
    """The nine kinds of facts of read_disassembly's rows, with their source. String constants keep their escapes.

    The text is gone through once: its tagged lines are written to the shared folder, and each kind of fact is read from there."""
    lines = written(tagged_lines(text), "lines")[0]
    at = lambda kind: lines.where(F.col("kind") == kind)
    get = lambda pattern, i: F.regexp_extract("value", pattern, i)
    field = "^\\s*\\.field\\s+(.*?)([^\\s:]+):([^\\s=]+)"
    method = "^\\s*\\.method\\s+(.*?)([^\\s(]+)\\("
    calls = at("call").select("source", F.col("class").alias("caller_class"), F.col("method").alias("caller_name"), F.col("args").alias("caller_args"), get(_CALL, 1).alias("callee_class"), get(_CALL, 2).alias("callee_name"), get(_CALL, 3).alias("callee_args"))
    access = at("access").select("source", get(_FIELD, 2).alias("field_class"), get(_FIELD, 3).alias("field_name"), get(_FIELD, 4).alias("field_ty"), F.col("class").alias("method_class"), F.col("method").alias("method_name"), F.col("args").alias("method_args"), F.when(get(_FIELD, 1) == "put", WRITE).otherwise(READ).alias("action"))
    literal = F.when(F.col("kind") == "string", get(_STRING, 1)).when((F.col("kind") == "field") & F.col("value").rlike(_FIELD_STRING), get(_FIELD_STRING, 1))
    strings = lines.withColumn("string", literal).where("string is not null")
    facts = {
        "classes": at("class").select("source", "class", _flags(get(_DIRECTIVES["class"], 1)).alias("flags")),
        "supers": at("super").select("source", F.col("class").alias("child"), get(_DIRECTIVES["super"], 1).alias("parent")),
        "interfaces": at("implements").select("source", "class", get(_DIRECTIVES["implements"], 1).alias("interface")),
        "class_fields": at("field").select("source", "class", get(field, 2).alias("name"), get(field, 3).alias("ty"), _flags(get(field, 1)).alias("flags")),
        "methods": at("method").select("source", "class", F.col("method").alias("name"), "args", "ret", _flags(get(method, 1)).alias("flags")),
        "calls": calls.distinct(),
        "method_field_access": access.distinct(),
        "strings": strings.select("source", "string").distinct(),
        "method_strings": strings.where("method <> ''").select("source", "string", "method", "args", "class").distinct(),
    }
    return ignore_library_classes(facts)


def instructions(text: DataFrame) -> DataFrame:
    """(source, class, method, args, ret, line, opcode, operands): instruction lines within methods, without labels, directives, comments and registers.

    A string literal is an operand as it stands: what looks like a register, a label or a comment inside it is text."""
    lines = disassembly_lines(text).where("method <> ''")
    literal = F.regexp_extract("value", _LITERAL, 0)
    lines = lines.withColumn("__literal", literal).withColumn("code", F.trim(F.regexp_replace(F.regexp_replace("value", _LITERAL, '""'), "(^|\\s+)#.*$", "")))
    lines = lines.where((F.col("code") != "") & ~F.col("code").rlike("^[.:#]"))
    operands = F.trim(F.regexp_replace(F.regexp_replace("code", "^\\S+\\s*", ""), "\\{[^}]*\\},?|\\b[vp]\\d+\\b,?|:\\w+", ""))
    return lines.select("source", "class", "method", "args", "ret", "line", F.regexp_extract("code", "^(\\S+)", 1).alias("opcode"), F.replace(operands, F.lit('""'), F.col("__literal")).alias("operands"), F.replace("code", F.lit('""'), F.col("__literal")).alias("code"))
