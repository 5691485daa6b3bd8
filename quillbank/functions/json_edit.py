"""Path edits and checks of JSON text as expressions: json_valid, json_type, json_set, json_remove.

A path is a list of member names and of array places from 0. Members keep their order and values their types and inner
layout; numbers are written in their shortest form where their object or array is edited. Text that is no JSON, or that
repeats a member name, is not valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Path = list[str | int]


def _parsed(text: Column) -> Column:
    """text as a variant; null if it is not JSON.

    The parser stops at the end of the first value. What comes after it breaks one of two wrappings: in an array only a
    bracket or a comma could follow, in an object a brace or a comma, and with a comma there is more than one element.
    """
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")) == 1
    whole = alone & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(whole, F.try_parse_json(text))


def json_valid(text: Column) -> Column:
    """Whether text is JSON; null for null."""
    return F.when(text.isNotNull(), _parsed(text).isNotNull())


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _literal(path: Path) -> str:
    """A path in the notation of variants; names must not hold a quote or bracket that it cannot write."""
    steps = []
    for x in path:
        if isinstance(x, str) and ("'" in x or "]" in x):
            raise ValueError(f"no such path: {path!r}")
        steps.append(f"[{x}]" if isinstance(x, int) else f"['{x}']")
    return "$" + "".join(steps)


def _found(text: Column, path: Path) -> Column:
    """The value at a path as a variant; null if there is none."""
    v = _parsed(text)
    return F.try_variant_get(v, _literal(path), "variant") if path else v


def json_type(text: Column, path: Path = ()) -> Column:
    """null, true, false, integer, real, text, array or object; null (no value) where the path leads nowhere.

    A number is real if it is written with a point or exponent, whatever its value.
    """
    v = _found(text, list(path))
    kind = F.schema_of_variant(v)
    truth = F.when(F.try_variant_get(v, "$", "boolean"), "true").otherwise("false")
    simple = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", truth).when(kind == "STRING", "text")
    nested = simple.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    number = F.get_json_object(text, _literal(list(path))) if path else text
    return F.when(v.isNotNull(), nested.when(number.rlike("[.eE]"), "real").otherwise("integer"))


def _raw(value: Column, typed: Column) -> Column:
    """The JSON of a value that was read as text, by its type."""
    return F.when(value.isNull(), "null").when(F.schema_of_variant(typed) == "STRING", _quoted(value)).otherwise(value)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _members(text: Column) -> Column:
    """(key, raw) of an object's members in order; null if text is no object."""

    def made(typed: Column) -> Column:
        entry = lambda e: F.struct(e["key"].alias("key"), _raw(e["value"], F.element_at(typed, e["key"])).alias("raw"))
        return F.when(typed.isNotNull(), F.transform(F.map_entries(F.from_json(text, "map<string,string>")), entry))

    return _let(F.try_parse_json(text).try_cast("map<string,variant>"), made)


def _elements(text: Column) -> Column:
    """The JSON of an array's elements in order; null if text is no array."""
    made = lambda typed: F.when(typed.isNotNull(), F.transform(F.from_json(text, "array<string>"), lambda x, i: _raw(x, F.get(typed, i))))
    return _let(F.try_parse_json(text).try_cast("array<variant>"), made)


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(_quoted(m["key"]), F.lit(":"), m["raw"])), ","), F.lit("}"))


def _in_object(text: Column, step: str, rest: Path, value: Column | None) -> Column:
    def made(members: Column) -> Column:
        if value is None and not rest:
            return F.filter(members, lambda m: m["key"] != step)
        new = lambda m: F.when(m["key"] == step, _edited(m["raw"], rest, value) if rest else value).otherwise(m["raw"])
        changed = F.transform(members, lambda m: F.struct(m["key"].alias("key"), new(m).alias("raw")))
        if rest:
            return changed
        added = F.concat(members, F.array(F.struct(F.lit(step).alias("key"), value.alias("raw"))))
        return F.when(F.exists(members, lambda m: m["key"] == step), changed).otherwise(added)

    return F.coalesce(_object(_let(_members(text), made)), text)


def _in_array(text: Column, step: int, rest: Path, value: Column | None) -> Column:
    def made(elements: Column) -> Column:
        if value is None and not rest:
            return F.filter(elements, lambda x, i: i != step)
        changed = F.transform(elements, lambda x, i: F.when(i == step, _edited(x, rest, value) if rest else value).otherwise(x))
        return changed if rest else F.when(F.size(elements) == step, F.concat(elements, F.array(value))).otherwise(changed)

    return F.coalesce(F.concat(F.lit("["), F.array_join(_let(_elements(text), made), ","), F.lit("]")), text)


def _edited(text: Column, path: Path, value: Column | None) -> Column:
    """text with the value (as JSON) at the path, or without what is there if value is None; as it is where that cannot be."""
    inside = _in_object if isinstance(path[0], str) else _in_array
    return _let(text, lambda t: inside(t, path[0], path[1:], value))


def json_set(text: Column, path: Path, value: Column) -> Column:
    """text with `value`, a JSON text, at the path: replaced, or added to the object or at the end of the array there.

    Nothing changes where the way to the last step is missing, where text is not valid, or where value is not.
    """
    if not path:
        raise ValueError("an empty path")
    both = F.struct(text.alias("text"), value.alias("value"))
    return _let(both, lambda b: F.when(json_valid(b["text"]) & json_valid(b["value"]), _edited(b["text"], list(path), b["value"])).otherwise(b["text"]))


def json_remove(text: Column, path: Path) -> Column:
    """text without the member or element at the path; as it is if there is none."""
    if not path:
        raise ValueError("an empty path")
    return _let(text, lambda t: F.when(json_valid(t), _edited(t, list(path), None)).otherwise(t))


def _members_after(members: Column, edits: list[tuple[Path, Column | None]]) -> Column:
    """(key, raw) of an object's members after edits that begin with a name; what lies in one member is edited at once."""
    if not edits:
        return members
    (step, *rest), value = edits[0]
    n = next((i for i, (path, _) in enumerate(edits) if path[0] != step or len(path) == 1), len(edits)) if rest else 1
    if rest:
        inner = [(path[1:], x) for path, x in edits[:n]]
        raw = lambda m: F.when(m["key"] == step, _edited_all(m["raw"], inner)).otherwise(m["raw"])
        done = F.transform(members, lambda m: F.struct(m["key"].alias("key"), raw(m).alias("raw")))
    elif value is None:
        done = F.filter(members, lambda m: m["key"] != step)
    else:
        changed = F.transform(members, lambda m: F.struct(m["key"].alias("key"), F.when(m["key"] == step, value).otherwise(m["raw"]).alias("raw")))
        added = F.concat(members, F.array(F.struct(F.lit(step).alias("key"), value.alias("raw"))))
        done = F.when(value.isNull(), members).when(F.exists(members, lambda m: m["key"] == step), changed).otherwise(added)
    return _let(done, lambda m: _members_after(m, edits[n:])) if edits[n:] else done


def _elements_after(elements: Column, edits: list[tuple[Path, Column | None]]) -> Column:
    """The JSON of an array's elements after edits that begin with a place."""
    if not edits:
        return elements
    (step, *rest), value = edits[0]
    if rest:
        done = F.transform(elements, lambda x, i: F.when(i == step, _edited_all(x, [(rest, value)])).otherwise(x))
    elif value is None:
        done = F.filter(elements, lambda x, i: i != step)
    else:
        changed = F.transform(elements, lambda x, i: F.when(i == step, value).otherwise(x))
        done = F.when(value.isNull(), elements).when(F.size(elements) == step, F.concat(elements, F.array(value))).otherwise(changed)
    return _let(done, lambda e: _elements_after(e, edits[1:])) if edits[1:] else done


def _edited_all(text: Column, edits: list[tuple[Path, Column | None]]) -> Column:
    """text after edits in order, taken apart once; names do nothing to an array and places nothing to an object."""
    named, placed = ([e for e in edits if isinstance(e[0][0], kind)] for kind in (str, int))

    def made(t: Column) -> Column:
        forms = []
        if named:
            forms.append(_object(_let(_members(t), lambda m: _members_after(m, named))))
        if placed:
            forms.append(F.concat(F.lit("["), F.array_join(_let(_elements(t), lambda e: _elements_after(e, placed)), ","), F.lit("]")))
        return F.coalesce(*forms, t)

    return _let(text, made)


def json_edited(text: Column, edits: list[tuple[Path, Column | None]]) -> Column:
    """text after several edits (path, JSON value, or None to remove what is there), as json_set() and json_remove() in order.

    text is checked and taken apart once for all of them, each value is checked once; an edit whose value is not valid is
    left out.
    """
    if not all(path for path, _ in edits):
        raise ValueError("an empty path")
    given = F.struct(text.alias("text"), *(F.when(json_valid(v), v).alias(f"v{i}") for i, (_, v) in enumerate(edits) if v is not None))
    values = lambda b: [(list(path), None if v is None else b[f"v{i}"]) for i, (path, v) in enumerate(edits)]
    return _let(given, lambda b: F.when(json_valid(b["text"]), _edited_all(b["text"], values(b))).otherwise(b["text"]))
