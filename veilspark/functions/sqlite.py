"""SQLite's meaning of LIKE, GLOB, LOWER, UPPER, CAST AS TEXT and the JSON functions, as Spark expressions."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(column: Column) -> Column:
    """ASCII letters only."""
    return F.translate(column, _UPPER, _LOWER)


def upper(column: Column) -> Column:
    return F.translate(column, _LOWER, _UPPER)


def _quoted(c: str) -> str:
    return "\\" + c if re.match(r"[^\w\s]", c, re.ASCII) and ord(c) < 128 else c


def like_regex(pattern: str) -> str:
    """Java regex of a LIKE pattern: letters of ASCII fold, % and _ are wild, nothing escapes."""
    return r"(?is)\A" + "".join({"%": ".*", "_": "."}.get(c) or _quoted(c) for c in pattern) + r"\z"


def like_match(column: Column, pattern: str) -> Column:
    # a folded prefix or equality needs no regex and lets the scan's statistics help little, so regex serves all
    return column.rlike(like_regex(pattern))


def like_column(column: Column, pattern: Column) -> Column:
    """LIKE with a pattern from a column: the regex is made row by row."""
    quoted = F.regexp_replace(pattern, r"([^\w\s%_])", r"\\$1")
    made = F.concat(F.lit(r"(?is)\A"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit(r"\z"))
    return F.rlike(column, made)


def glob_regex(pattern: str) -> str:
    """Java regex of a GLOB pattern: * ? [set] [^set], with case."""
    out, i = [r"(?s)\A"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            negated = j < len(pattern) and pattern[j] == "^"
            j += negated
            first = j
            if j < len(pattern) and pattern[j] == "]":
                j += 1
            while j < len(pattern) and pattern[j] != "]":
                j += 1
            if j >= len(pattern):
                return r"(?!)"  # an open class matches nothing
            body = pattern[first:j]
            parts, k = [], 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    if body[k] <= body[k + 2]:
                        parts.append(f"{_quoted(body[k])}-{_quoted(body[k + 2])}")
                    k += 3
                else:
                    parts.append(_quoted(body[k]))
                    k += 1
            out.append(f"[{'^' if negated else ''}{''.join(parts)}]" if parts else ("." if negated else "(?!)"))
            i = j
        else:
            out.append(_quoted(c))
        i += 1
    return "".join(out) + r"\z"


def glob_match(column: Column, pattern: str) -> Column:
    return column.rlike(glob_regex(pattern))


def glob_column(column: Column, pattern: Column) -> Column:
    """GLOB with a pattern from a column: patterns become regexes in Arrow batches, the match stays in the JVM."""

    def translate(patterns: pd.Series) -> pd.Series:
        from veilspark.functions.sqlite import glob_regex

        return patterns.map(glob_regex, na_action="ignore")

    translate.__annotations__ = {"patterns": pd.Series, "return": pd.Series}
    return F.rlike(column, F.pandas_udf(translate, "string")(pattern))


def cast_text(column: Column, stored: T.DataType) -> Column:
    """Booleans are 1 and 0; doubles have 15 significant digits and always a point or an exponent."""
    if isinstance(stored, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(stored, (T.DoubleType, T.FloatType)):
        return double_text(column.cast("double"))
    return column.cast("string")


def double_text(d: Column) -> Column:
    """As C's %!.15g, in JVM expressions: 15 significant digits, trailing zeros cut, one kept after the point.

    Java prints the shortest digits that name a double, so subnormal numbers show fewer digits than C's.
    """
    sci = F.format_string("%.14e", d)  # d.dddddddddddddde+xx
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(-?\d\.\d+)e", 1), r"0+$", "")
    mantissa = F.when(mantissa.endswith("."), F.concat(mantissa, F.lit("0"))).otherwise(mantissa)
    wide = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    digits = F.replace(F.regexp_extract(sci, r"^-?(\d\.\d+)e", 1), F.lit("."), F.lit(""))
    sign = F.when(d < 0, "-").otherwise("")
    whole = F.when(exponent >= 0, F.substring(digits, F.lit(1), exponent + 1)).otherwise("0")
    fraction = F.when(exponent >= 0, F.substring(digits, exponent + 2, F.lit(15))).otherwise(F.concat(F.repeat(F.lit("0"), -exponent - 1), digits))
    fraction = F.regexp_replace(fraction, r"0+$", "")
    plain = F.concat(sign, whole, F.lit("."), F.when(fraction == "", "0").otherwise(fraction))
    return F.when(d.isNull() | F.isnan(d), None).when(d == 0, "0.0").when(F.abs(d) == float("inf"), F.when(d > 0, "Inf").otherwise("-Inf")).when((exponent < -4) | (exponent >= 15), wide).otherwise(plain)


# ---- JSON ----

_STEP = re.compile(r"\.(?:\"([^\"]+)\"|([A-Za-z_][A-Za-z0-9_]*))|\[(\d+)\]")


def json_path(path: str) -> list[str | int] | None:
    """Steps of $, .name and [n]; None for anything else."""
    if not path.startswith("$"):
        return None
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        steps.append(int(m[3]) if m[3] is not None else m[1] or m[2])
        at = m.end()
    return steps


def schema_at(schema: dict | None, steps: list[str | int]) -> dict | None:
    """The part of a JSON schema that a path reaches; None if it leaves the schema."""
    if schema is None:
        return None
    if not steps:
        return schema
    if "anyOf" in schema:
        found = [s for s in (schema_at(x, steps) for x in schema["anyOf"]) if s]
        return found[0] if len(found) == 1 else {"anyOf": found} if found else None
    step = steps[0]
    if isinstance(step, int):
        return schema_at(schema.get("items"), steps[1:]) if schema.get("type") == "array" else None
    return schema_at((schema.get("properties") or {}).get(step), steps[1:]) if schema.get("type") == "object" else None


def json_kind(schema: dict | None) -> str:
    """What JSON_EXTRACT yields: string, integer, number, boolean, or json for objects, arrays and mixtures."""
    kind = (schema or {}).get("type")
    return kind if kind in ("string", "integer", "number", "boolean") else "json"


def _spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def json_extract(doc: Column, steps: list[str | int], kind: str) -> Column:
    """Scalars by their proven type, true and false as 1 and 0, objects and arrays as text, missing and null as NULL."""
    text = F.get_json_object(doc, _spark_path(steps))
    if kind == "integer":
        return text.try_cast("bigint")
    if kind == "number":
        return text.try_cast("double")
    if kind == "boolean":
        return F.when(text == "true", 1).when(text == "false", 0).cast("bigint")
    return text


def json_each_values(doc: Column, steps: list[str | int]) -> Column:
    """Array of JSON texts: elements of an array, values of an object in document order, or the scalar itself."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in steps)
    node = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    text = F.to_json(node)
    shown = F.when(F.is_variant_null(node), "null").otherwise(text)
    keys = F.json_object_keys(F.get_json_object(doc, _spark_path(steps)))
    scalar = lambda t: F.when(t == "true", "1").when(t == "false", "0").otherwise(F.coalesce(t, F.lit("null")))
    members = F.try_variant_get(node, "$", "map<string,variant>")
    of_object = F.transform(keys, lambda k: scalar(F.to_json(F.try_element_at(members, k))))
    length = F.json_array_length(text)
    of_array = F.when(length > 0, F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: scalar(_element(node, i)))).otherwise(F.array().cast("array<string>"))
    return F.when(doc.isNull() | node.isNull() & ~F.coalesce(F.is_variant_null(node), F.lit(False)), F.array().cast("array<string>")).when(shown.startswith("{"), F.coalesce(of_object, F.array().cast("array<string>"))).when(shown.startswith("["), of_array).otherwise(F.array(scalar(shown)))


def _element(node: Column, index: Column) -> Column:
    return F.to_json(F.try_variant_get(node, F.concat(F.lit("$["), index.cast("string"), F.lit("]")), "variant"))


def tree_walker(steps: list[str | int]) -> Any:
    """json_tree's values of a document: the node at the path and all below it, parents first.

    The function carries all it needs, so Python workers don't have to import this package.
    """
    import json

    def values(doc: str | None) -> list[str]:
        try:
            value = json.loads(doc) if doc is not None else None
        except ValueError:
            return []
        if doc is None:
            return []
        for s in steps:
            if isinstance(value, list) if isinstance(s, int) else isinstance(value, dict):
                if s not in (range(len(value)) if isinstance(s, int) else value):
                    return []
                value = value[s]
            else:
                return []
        out, left = [], [value]
        while left:
            v = left.pop()
            out.append("1" if v is True else "0" if v is False else json.dumps(v, ensure_ascii=False, separators=(",", ":")))
            left.extend(reversed(list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []))
        return out

    return values


def json_tree_values(doc: Column, steps: list[str | int]) -> Column:
    """Walks of any depth have no form in JVM expressions: an Arrow-batched function."""
    values = tree_walker(steps)

    def walk(docs: pd.Series) -> pd.Series:
        return docs.map(values)

    walk.__annotations__ = {"docs": pd.Series, "return": pd.Series}
    return F.pandas_udf(walk, "array<string>")(doc)
