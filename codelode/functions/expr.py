"""Scalar functions as column expressions: class names, signatures, device paths, flags, tri-state values, permissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.schema import ABSTRACT, FALSE, PUBLIC, TRUE, UNKNOWN

# Class names: a.b.C, and La/b/C; as class files spell it.


def is_slashed(c: Column) -> Column:
    return c.startswith("L") & c.endswith(";")


def to_dotted(c: Column) -> Column:
    """La/b/C; becomes a.b.C; anything else stays."""
    return F.when(is_slashed(c), F.translate(F.substring(c, F.lit(2), F.length(c) - 2), "/", ".")).otherwise(c)


def to_slashed(c: Column) -> Column:
    """a.b.C becomes La/b/C;; a name in that spelling stays."""
    return F.when(is_slashed(c), c).otherwise(F.concat(F.lit("L"), F.translate(c, ".", "/"), F.lit(";")))


def class_path(c: Column, extension: str = ".smali") -> Column:
    """The file that a class is disassembled to, relative to its source's directory."""
    return F.concat(F.translate(to_dotted(c), ".", "/"), F.lit(extension))


def simple_name(c: Column) -> Column:
    return F.substring_index(to_dotted(c), ".", -1)


def package_of(c: Column) -> Column:
    """Empty for a class in no package."""
    return F.regexp_replace(to_dotted(c), "\\.?[^.]*$", "")


def has_package(c: Column) -> Column:
    return F.ltrim(to_dotted(c), F.lit(".")).contains(".")


def with_package(c: Column, package: Column) -> Column:
    return F.concat_ws(".", F.when(package != "", package), simple_name(c))


def with_simple_name(c: Column, name: Column) -> Column:
    return F.concat_ws(".", F.when(package_of(c) != "", package_of(c)), name)


def from_manifest_name(package: Column, name: Column) -> Column:
    """A class as a manifest names it: pkg/cls gives its own package, and a leading dot stands for the package."""
    slash = F.instr(name, "/") > 0
    pkg = F.when(slash, F.substring_index(name, "/", 1)).otherwise(package)
    cls = F.when(slash, F.regexp_replace(name, "^[^/]*/", "")).otherwise(name)
    return F.when(cls.startswith("."), F.concat(pkg, cls)).otherwise(cls)


# Signatures.

_TYPE = "\\[*(?:L[^;]+;|[ZBSCIJFD])"


def split_signature(args: Column) -> Column:
    """The types of an argument list; null if it isn't one. An empty list has none."""
    parts = F.regexp_extract_all(args, F.lit(_TYPE), 0)
    return F.when(F.array_join(parts, "") == args, parts)


def method_display(cls: Column, name: Column, args: Column, ret: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, F.lit("("), F.coalesce(args, F.lit("?")), F.lit(")"), F.coalesce(ret, F.lit("?")))


def field_display(cls: Column, name: Column, ty: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, F.lit(":"), ty)


def method_key(name: Column, signature: Column, ret: Column) -> Column:
    """What matches a service's method with the other snapshot's; null parts count as empty."""
    return F.concat_ws("|", name, F.coalesce(signature, F.lit("")), F.coalesce(ret, F.lit("")))


def argument_hash(*args: Column) -> Column:
    """SHA-256 over the arguments in order; null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *(F.when(a.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("="), a.cast("string"))) for a in args)), 256)


def is_binder_like(types: Column) -> Column:
    """Some class type (arrays aside) has a simple name that starts with I, or holds Callback or Listener."""
    def one(t: Column) -> Column:
        name = F.regexp_extract(t, "([^/;]*);$", 1)
        return t.startswith("L") & (name.rlike("^I") | name.contains("Callback") | name.contains("Listener"))

    return F.exists(types, one)


def has_class(types: Column) -> Column:
    return F.exists(types, lambda t: t.startswith("L"))


# Device paths. /a/b.apk is squashed to %a%b.apk; \ escapes % and itself.


def squash(path: Column) -> Column:
    escaped = F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%"))
    return F.translate(escaped, "/", "%")


def unsquash(path: Column) -> Column:
    """The inverse. Escapes are hidden behind two control characters first."""
    hidden = F.replace(F.replace(path, F.lit("\\\\"), F.lit("\x01")), F.lit("\\%"), F.lit("\x02"))
    return F.translate(F.translate(hidden, "%", "/"), "\x01\x02", "\\%")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; null without one."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def source_file_parts(path: Column) -> Column:
    """A disassembly file's source, class and package file: <project>/<framework or squashed package>/.../a/b/C.smali."""
    framework = path.rlike("(^|/)framework/")
    source = F.when(framework, F.lit("framework")).otherwise(F.regexp_extract(path, "(?:^|/)(%[^/]+)/", 1))
    cls = F.translate(F.regexp_extract(path, "(?:^|/)(?:framework|%[^/]+)/(?:smali[^/]*/)?(.+)\\.smali$", 1), "/", ".")
    return F.struct(source.alias("source"), cls.alias("class_name"), F.when(~framework, unsquash(source)).alias("package_file"))


# Access flags.


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == F.lit(mask)


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def is_public(flags: Column) -> Column:
    return has_any(flags, PUBLIC)


def is_not_abstract(flags: Column) -> Column:
    return ~has_any(flags, ABSTRACT)


def flags_union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def flags_intersection(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def flags_difference(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def flags_symmetric_difference(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


# Tri-state values: 1 true, -1 false, 0 (and any other code, and null) unknown.


def tri_from_bool(b: Column) -> Column:
    return F.when(b, TRUE).when(~b, FALSE).otherwise(UNKNOWN)


def tri_from_code(code: Column) -> Column:
    return F.when(code.isin(TRUE, FALSE), code.cast("int")).otherwise(UNKNOWN)


def tri_known(v: Column) -> Column:
    return tri_from_code(v) != UNKNOWN


def tri_true_or_unknown(v: Column) -> Column:
    return tri_from_code(v) != FALSE


def tri_false_or_unknown(v: Column) -> Column:
    return tri_from_code(v) != TRUE


def tri_and(a: Column, b: Column) -> Column:
    """The left side decides unless it is true: (unknown, false) is unknown, (false, unknown) is false. Not SQL's AND."""
    a, b = tri_from_code(a), tri_from_code(b)
    return F.when(a == TRUE, b).otherwise(a)


def tri_or(a: Column, b: Column) -> Column:
    """True if either is true, false if both are false, else unknown."""
    a, b = tri_from_code(a), tri_from_code(b)
    return F.when((a == TRUE) | (b == TRUE), TRUE).when((a == FALSE) & (b == FALSE), FALSE).otherwise(UNKNOWN)


def tri_text(v: Column) -> Column:
    v = tri_from_code(v)
    return F.when(v == TRUE, "true").when(v == FALSE, "false").otherwise("unknown")


# Components.


def authorities(a: Column) -> Column:
    return F.split(a, "[:;]")


def permission_for_mode(mode: str, generic: Column, read: Column, write: Column) -> Column:
    """mode: generic, read, write, or any (the first of the three that there is)."""
    return {"generic": generic, "read": read, "write": write, "any": F.coalesce(generic, read, write)}[mode]


def requires_no_permission(*modes: Column) -> Column:
    return F.coalesce(*modes).isNull()


def ilike_pattern(pattern: str) -> str:
    """A LIKE pattern whose backslashes are ordinary characters, as Spark's LIKE writes it."""
    return pattern.replace("\\", "\\\\")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# Paths of calls: arrays of method structs or ids, outermost first.


def path_src(path: Column) -> Column:
    return F.element_at(path, 1)


def path_dst(path: Column) -> Column:
    return F.element_at(path, -1)


def path_len(path: Column) -> Column:
    return F.size(path)


def path_is_empty(path: Column) -> Column:
    return F.size(path) == 0


def without_last(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def file_path(uri: Column) -> Column:
    """The text of a file's URI, as input_file_name gives it, with its escapes undone."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
