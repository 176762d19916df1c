"""A declared JSON schema as one column expression: what a document breaks, without Python in the tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON types as the schema of a variant names them (fixed values).
KINDS = {"object": r"OBJECT<", "array": r"ARRAY<", "string": r"STRING\z", "integer": r"BIGINT\z", "number": r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z", "boolean": r"BOOLEAN\z", "null": r"VOID\z"}
DEEPEST = 20


def errors(schema: dict, document: Column) -> Column:
    """document: a variant. An array of `path: what is wrong`; empty where the schema is met. A null document (no JSON) is one error.

    Understood: $ref within the schema, type, const, enum, required, properties,
    additionalProperties (false), pattern, minLength, minimum, maximum, minItems,
    maxItems, items, anyOf and oneOf. A keyword that is none of these and no
    annotation is refused, as are references that lead into themselves.
    """
    none = F.array(F.lit("$: no JSON document"))
    return F.when(document.isNull(), none).otherwise(_errors(schema, document, F.lit("$"), schema, 0))


_KNOWN = {"$ref", "type", "const", "enum", "required", "properties", "additionalProperties", "pattern", "minLength", "minimum", "maximum", "minItems", "maxItems", "items", "anyOf", "oneOf"}
_NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples"}


def _errors(schema: dict, value: Column, path: Column, root: dict, depth: int) -> Column:
    if depth > DEEPEST:
        raise ValueError("a schema that refers to itself")
    if strange := set(schema) - _KNOWN - _NOTES:
        raise ValueError(f"unsupported keywords: {sorted(strange)}")
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return _errors(target, value, path, root, depth + 1)
    found: list[Column] = []
    wrong = lambda bad, text: found.append(F.when(bad, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(_none()))
    kind = F.schema_of_variant(value)
    is_ = lambda name: kind.rlike(rf"\A{KINDS[name]}")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = is_(names[0])
        for name in names[1:]:
            ok = ok | is_(name)
        wrong(~ok, f"type is not {' or '.join(names)}")
    said = F.to_json(value)
    same = lambda x: said == json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    if "const" in schema:
        wrong(~same(schema["const"]), "not the constant")
    if "enum" in schema:
        wrong(~F.coalesce(said.isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]), F.lit(False)), "not in enum")
    if "pattern" in schema:
        wrong(is_("string") & ~text.rlike(schema["pattern"]), "pattern")
    if "minLength" in schema:
        wrong(is_("string") & (F.length(text) < schema["minLength"]), "minLength")
    if "minimum" in schema:
        wrong(is_("number") & (number < schema["minimum"]), "minimum")
    if "maximum" in schema:
        wrong(is_("number") & (number > schema["maximum"]), "maximum")
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    if "minItems" in schema:
        wrong(is_("array") & (F.size(items) < schema["minItems"]), "minItems")
    if "maxItems" in schema:
        wrong(is_("array") & (F.size(items) > schema["maxItems"]), "maxItems")
    if "items" in schema:
        found.append(F.flatten(F.transform(items, lambda x, i: _errors(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), root, depth + 1))))
    field = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    for name in schema.get("required", []):
        wrong(is_("object") & field(name).isNull(), f"{name} is missing")
    for name, sub in schema.get("properties", {}).items():
        deeper = _errors(sub, field(name), F.concat(path, F.lit(f".{name}")), root, depth + 1)
        found.append(F.when(is_("object") & field(name).isNotNull(), deeper).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        more = F.array_except(F.coalesce(F.json_object_keys(said), _none()), F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
        found.append(F.when(is_("object"), F.transform(more, lambda n: F.concat(path, F.lit(": unexpected "), n))).otherwise(_none()))
    for keyword in ("anyOf", "oneOf"):
        if keyword in schema:
            met = [F.when(F.size(_errors(sub, value, path, root, depth + 1)) == 0, 1).otherwise(0) for sub in schema[keyword]]
            total = met[0]
            for m in met[1:]:
                total = total + m
            wrong(total < 1 if keyword == "anyOf" else total != 1, keyword)
    return F.concat(*found) if found else _none()


def _none() -> Column:
    return F.array().cast("array<string>")
