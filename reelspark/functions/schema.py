"""JSON Schema documents compiled to column expressions.

``violations`` takes a VARIANT and says what of the schema it breaks, each with the path where. Supported are the
keywords type, const, enum, pattern, minLength, maxLength, minimum, maximum, required, properties,
additionalProperties (false), items, minItems, maxItems, uniqueItems, allOf, if/then/else and $ref into the document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,rule:string>>"
KEYWORDS = {"type", "const", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems",
            "maxItems", "uniqueItems", "allOf", "if", "then", "else", "$ref", "$defs"}


def _none() -> Column:
    return F.array().cast(FOUND)


def _said(broken: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(_none())


def _named(values: Column, many) -> Column:
    """``many`` of each value, joined; binds the value to a name, since written out it would be repeated at every level."""
    return F.coalesce(F.flatten(F.transform(values, many)), _none())


def _read(values: Column) -> Column:
    """VARIANTs with what the keywords ask of them, read once each; no kind is looked up of objects and arrays, which would walk all of them."""
    v = lambda x: x.getField("v")
    rows = F.transform(values, lambda x: F.struct(x.alias("v"), F.try_variant_get(x, "$", "map<string,variant>").alias("fields"), F.try_variant_get(x, "$", "array<variant>").alias("items")))
    rows = F.transform(rows, lambda x: F.struct(v(x).alias("v"), x.getField("fields").alias("fields"), x.getField("items").alias("items"),
                                                F.when(x.getField("fields").isNotNull(), "OBJECT").when(x.getField("items").isNotNull(), "ARRAY").otherwise(F.schema_of_variant(v(x))).alias("kind")))
    numeric = lambda kind: kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.transform(rows, lambda x: F.struct(
        x.getField("fields").alias("fields"), x.getField("items").alias("items"), x.getField("kind").alias("kind"), F.when(x.getField("kind") == "STRING", F.try_variant_get(v(x), "$", "string")).alias("text"),
        F.when(numeric(x.getField("kind")), F.try_variant_get(v(x), "$", "double")).alias("number"), F.when(x.getField("kind") == "BOOLEAN", F.try_variant_get(v(x), "$", "boolean")).alias("flag")))


class _Schema:
    def __init__(self, root: dict):
        self.root = root

    def is_type(self, v: Column, name: str) -> Column:
        kind, number = v.getField("kind"), v.getField("number")
        return {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "object": kind == "OBJECT", "array": kind == "ARRAY",
                "number": number.isNotNull(), "integer": number.isNotNull() & (number == F.floor(number))}[name]

    def equals(self, v: Column, value) -> Column:
        if isinstance(value, bool):
            return v.getField("flag") == value
        if isinstance(value, str):
            return v.getField("text") == value
        if isinstance(value, int | float):
            return v.getField("number") == float(value)
        if value is None:
            return self.is_type(v, "null")
        raise ValueError(f"only scalars can be compared, not {value!r}")

    def below(self, path: Column, schema: dict | bool):
        return lambda x: self.found(x, path, schema)

    def found(self, v: Column, path: Column, schema: dict | bool) -> Column:
        if isinstance(schema, bool):
            return _none() if schema else _said(F.lit(True), path, "false")
        if unknown := {k for k in schema if not k.startswith("$") and k not in ("title", "description")} - KEYWORDS:
            raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
        out = []
        if "$ref" in schema:
            target = self.root
            for step in schema["$ref"].removeprefix("#/").split("/"):
                target = target[step]
            out.append(self.found(v, path, target))
        if "type" in schema:
            out.append(_said(~self.is_type(v, schema["type"]), path, "type"))
        for rule, values in (("const", [schema["const"]] if "const" in schema else None), ("enum", schema.get("enum"))):
            if values is not None:
                same = F.lit(False)
                for x in values:
                    same = same | F.coalesce(self.equals(v, x), F.lit(False))
                out.append(_said(~same, path, rule))
        text, number, items, fields = (v.getField(x) for x in ("text", "number", "items", "fields"))
        bounds = {"pattern": lambda x: ~text.rlike(x), "minLength": lambda x: F.length(text) < x, "maxLength": lambda x: F.length(text) > x, "minimum": lambda x: number < x, "maximum": lambda x: number > x,
                  "minItems": lambda x: F.size(items) < x, "maxItems": lambda x: F.size(items) > x,
                  "uniqueItems": lambda x: F.lit(x) & (F.size(F.array_distinct(F.transform(items, lambda y: F.to_json(y)))) < F.size(items))}
        out += [_said(broken(schema[k]), path, k) for k, broken in bounds.items() if k in schema]
        if "items" in schema:
            out.append(_named(_read(items), lambda x, i: self.found(x, F.concat(path, F.lit("/"), i.cast("string")), schema["items"])))
        out += [_said(~F.map_contains_key(fields, F.lit(k)), F.concat(path, F.lit(f"/{k}")), "required") for k in schema.get("required", ())]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            more = F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in known]).cast("array<string>"))
            out.append(_named(more, lambda k: F.array(F.struct(F.concat(path, F.lit("/"), k).alias("path"), F.lit("additionalProperties").alias("rule")))))
        for k, inner in known.items():
            if inner is not True:
                value = F.try_element_at(fields, F.lit(k))
                out.append(_named(F.when(value.isNotNull(), _read(F.array(value))), self.below(F.concat(path, F.lit(f"/{k}")), inner)))
        out += [self.found(v, path, part) for part in schema.get("allOf", ())]
        if "if" in schema:
            holds = F.size(self.found(v, path, schema["if"])) == 0
            out.append(F.when(holds, self.found(v, path, schema.get("then", True))).otherwise(self.found(v, path, schema.get("else", True))))
        return F.concat(*out) if out else _none()


def violations(doc: Column, schema: dict) -> Column:
    """Array of (path, rule) that the VARIANT breaks, empty for a valid document; null where there is no document."""
    found = F.transform(F.array(doc), lambda v: F.when(v.isNotNull(), F.flatten(F.transform(_read(F.array(v)), lambda x: _Schema(schema).found(x, F.lit(""), schema)))))
    return F.get(found, 0)
