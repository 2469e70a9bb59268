"""Column functions over names: hook parts, role suffixes, dotted names, ids, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of function names that make a hook; the first in this order that occurs anywhere in the lower-cased name is reported.
HOOK_PARTS = "register unregister add_ on_ hook subscribe listen connect emit dispatch plugin extend handler callback".split()
#: Hook parts whose functions are called back; the others register something.
CALLED_PARTS = "on_ hook emit dispatch listen".split()
#: Case-sensitive endings of class names. No one is an ending of another, so at most one fits.
ROLE_ENDINGS = "Adapter Backend Base Component Controller Directive Driver Extension Handler Hook Listener Middleware Module Plugin Provider Reducer Service Store Strategy".split()
#: Parts of decorators that register the function.
DECORATOR_PARTS = "register hook on_ subscribe plugin command route listener".split()


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def first_part(text: Column, parts: list[str]) -> Column:
    """The first of parts that the lower-cased text contains; null if none."""
    return F.get(F.filter(_strings(parts), lambda p: F.lower(text).contains(p)), 0)


def hook_part(name: Column) -> Column:
    return first_part(name, HOOK_PARTS)


def decorator_part(decorators: Column) -> Column:
    return first_part(decorators, DECORATOR_PARTS)


def role_ending(name: Column) -> Column:
    """The role that a class name ends in; null if none."""
    found = F.regexp_extract(name, f"({'|'.join(ROLE_ENDINGS)})$", 1)
    return F.when(found != "", found)


def base_role(bases: Column) -> Column:
    """The role of the first of the comma-separated bases that has one; null if none does."""
    roles = F.transform(F.split(bases, ","), lambda b: role_ending(F.trim(b)))
    return F.get(F.filter(roles, lambda r: r.isNotNull()), 0)


def bare(base: Column) -> Column:
    """Last dotted segment, then the text before a bracket."""
    return F.trim(F.split(F.substring_index(base, ".", -1), "\\[")[0])


def bare_type(name: Column) -> Column:
    """Text before a type argument, then its last dotted segment."""
    return F.substring_index(F.trim(F.substring_index(name, "<", 1)), ".", -1)


def tail2(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -2)


def slug(text: Column) -> Column:
    """Every character that is no letter or digit becomes an underscore."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N}]", "_")


def point_id(module: Column, name: Column, fallback: Column | None = None) -> Column:
    """module:name, with a fallback for the root package, whose name is empty."""
    return F.concat(F.when(F.coalesce(module, F.lit("")) != "", module).otherwise(fallback if fallback is not None else F.lit("")), F.lit(":"), name)


def target_id(target: Column, module: Column, name: Column) -> Column:
    """An id that begins with its target once, however often it is applied."""
    inside = (module == target) | module.startswith(F.concat(target, F.lit(".")))
    full = F.when(module == "", target).when(inside, module).otherwise(F.concat(target, F.lit("."), module))
    return F.concat(full, F.lit(":"), name)


def location(module: Column, line: Column) -> Column:
    return F.concat(module, F.lit(":"), line.cast("string"))


def line_of(place: Column) -> Column:
    """The line number of a location; 0 where there is none."""
    return F.coalesce(F.substring_index(place, ":", -1).try_cast("int"), F.lit(0))


def function_signature(name: Column, args: Column) -> Column:
    return F.concat(F.lit("def "), name, F.lit("("), F.array_join(args, ", "), F.lit(")"))


def class_signature(name: Column, bases: Column) -> Column:
    """class X(a, b), or class X where there are no bases."""
    return F.concat(F.lit("class "), name, F.when(F.size(bases) > 0, F.concat(F.lit("("), F.array_join(bases, ", "), F.lit(")"))).otherwise(""))


def method_of(signature: Column) -> Column:
    """The name in 'def name(args)'; 'method' where there is none."""
    name = F.trim(F.substring_index(F.regexp_replace(signature, "^def ", ""), "(", 1))
    return F.when(name == "", F.lit("method")).otherwise(name)


def qualname(path: Column, dialect: str = "python") -> Column:
    """Module name of a relative path. python: dotted, without .py and __init__; slash: without the ending; dotted: without the ending."""
    stem = F.regexp_replace(path, "\\.[^./]*$", "")
    if dialect == "slash":
        return stem
    parts = F.split(stem, "/")
    return F.array_join(F.array_remove(parts, "__init__") if dialect == "python" else parts, ".")


ARCHIVES = "https://repo1.maven.org/maven2"


def archive_url(coordinate: Column, version: Column) -> Column:
    """Where the sources of group:artifact in a version lie."""
    group, artifact = F.substring_index(coordinate, ":", 1), F.substring_index(coordinate, ":", -1)
    return F.concat_ws("/", F.lit(ARCHIVES), F.replace(group, F.lit("."), F.lit("/")), artifact, version, F.concat(artifact, F.lit("-"), version, F.lit("-sources.jar")))


def archive_folder(root: Column, name: Column, version: Column) -> Column:
    """The folder that a version's sources are unpacked in."""
    return F.concat(root, F.lit("/"), name, F.lit("-"), version)
