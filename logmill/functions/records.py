"""JSON container columns: strict parsing, records of a document, path lookup and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logmill.functions.text import is_blank, let, text_lines

JSON_START = r'^[ \t\r\n]*[\[{"0-9tfn-]'
CONTAINER_START = r"^[ \t\r\n]*[\[{]"


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    ``try_parse_json`` alone accepts trailing text, so the value is also parsed inside an array
    and inside an object: only a complete single value fits both.
    """

    def parsed(t: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).try_cast("array<variant>")
        named = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return let(
            listed,
            lambda a: F.when((F.size(a) == 1) & named.isNotNull(), F.get(a, F.lit(0))),
        )

    return let(text, lambda t: F.when(t.rlike(JSON_START), parsed(t)))


def json_records(text: Column) -> Column:
    """ARRAY<VARIANT> of a JSON document, or NULL when the text is not a JSON container.

    An object is one record, an array its items, and two or more non-blank lines that are all
    JSON values are one record each. Text that cannot open a JSON value is never parsed.
    """

    def whole(t: Column) -> Column:
        def split_up(v: Column) -> Column:
            items = v.try_cast("array<variant>")
            is_object = F.startswith(F.ltrim(t), F.lit("{"))
            return F.coalesce(items, F.when(v.isNotNull() & is_object, F.array(v)))

        return F.when(t.rlike(CONTAINER_START), let(strict_json(t), split_up))

    def by_line(t: Column) -> Column:
        def parsed(lines: Column) -> Column:
            # the first line is tried alone, so plain text costs one failed parse at most
            values = F.when(
                (F.size(lines) > 1)
                & F.forall(lines, lambda x: x.rlike(JSON_START))
                & strict_json(F.get(lines, F.lit(0))).isNotNull(),
                F.transform(lines, strict_json),
            )
            return let(values, lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), vs))

        kept = F.filter(text_lines(t), lambda x: ~is_blank(x))
        return F.when(t.rlike(JSON_START), let(kept, parsed))

    return let(text, lambda t: F.coalesce(whole(t), by_line(t)))


def with_fields(record: Column) -> Column:
    """``struct<value, fields>``: the record and its top-level fields, taken apart once.

    The many path lookups of detectors and parsers then only search a small map.
    """
    return F.struct(
        record.alias("value"), record.try_cast("map<string,variant>").alias("fields")
    )


def _step(key: str) -> str:
    return '["' + key + '"]' if '"' not in key else "['" + key + "']"


def at_path(fields: Column, path: str) -> Column:
    """VARIANT at ``$.a.b`` of a field map: first the literal key ``a.b``, then ``a`` and ``b``.

    A JSON null is a value here (not SQL NULL), so the result tells presence.
    """
    if not path.startswith("$."):
        return F.lit(None).cast("variant")
    rest = path[2:]
    literal = F.try_element_at(fields, F.lit(rest))
    if "." not in rest:
        return literal
    first, *others = rest.split(".")
    nested = F.try_variant_get(
        F.try_element_at(fields, F.lit(first)), "$" + "".join(map(_step, others)), "variant"
    )
    return F.coalesce(literal, nested)


def path_exists(fields: Column, path: str) -> Column:
    return at_path(fields, path).isNotNull()


def value_text(value: Column) -> Column:
    """Strings as they are, other values as compact JSON; JSON null gives SQL NULL."""
    return value.try_cast("string")


def path_text(fields: Column, path: str) -> Column:
    return value_text(at_path(fields, path))


def first_value(fields: Column, paths: list[str]) -> Column:
    """First path whose text is not empty, ``null`` or ``{}``."""
    if not paths:
        return F.lit(None).cast("string")
    found = []
    for path in paths:
        text = path_text(fields, path)
        found.append(let(text, lambda t: F.when(~t.isin("", "null", "{}"), t)))
    return F.coalesce(*found)


def path_or_null_word(fields: Column, path: str) -> Column:
    """Text at a path where a present JSON null reads ``null``; NULL when absent."""
    return let(
        at_path(fields, path),
        lambda v: F.coalesce(value_text(v), F.when(v.isNotNull(), F.lit("null"))),
    )
