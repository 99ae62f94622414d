"""JSON Schemas of services as Spark types, examples and documentation."""

from __future__ import annotations

from pyspark.sql import types as T

DEPTH = 8
SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
EXAMPLES = {"string": "", "number": 0, "integer": 0, "boolean": False, "array": [], "object": {}}


def kind(schema: dict) -> str | None:
    found = schema.get("type")
    return next((x for x in found if x != "null"), None) if isinstance(found, list) else found


def spark_type(schema: dict, depth: int = 0) -> T.DataType:
    """The type of a schema; what it doesn't say is a string."""
    if depth > DEPTH:
        return T.StringType()
    k = kind(schema)
    if k == "object" and schema.get("properties"):
        return T.StructType([T.StructField(n, spark_type(s, depth + 1)) for n, s in schema["properties"].items()])
    if k == "object":
        return T.MapType(T.StringType(), T.StringType())
    if k == "array":
        return T.ArrayType(spark_type(schema.get("items") or {}, depth + 1))
    return SCALARS.get(k, T.StringType())


def leaf_paths(schema: dict, prefix: str = "", depth: int = 0) -> list[str]:
    """Dotted paths of leaves, through arrays of objects."""
    if depth > DEPTH:
        return []
    if kind(schema) == "array" and kind(schema.get("items") or {}) == "object":
        schema = schema["items"]
    if kind(schema) != "object" or not schema.get("properties"):
        return [prefix] if prefix else []
    return [p for n, s in schema["properties"].items() for p in leaf_paths(s, f"{prefix}.{n}" if prefix else n, depth + 1)]


def collections(schema: dict) -> list[str]:
    """Properties that hold arrays of objects."""
    return [n for n, s in (schema.get("properties") or {}).items() if kind(s) == "array" and kind(s.get("items") or {}) == "object"]


def example(schema: dict):
    """A value for a schema: its first example, or what its type begins with."""
    if schema.get("examples"):
        return schema["examples"][0]
    if kind(schema) == "object" and schema.get("properties"):
        return {n: example(s) for n, s in schema["properties"].items()}
    return EXAMPLES.get(kind(schema))


def field_table(schema: dict) -> str:
    rows = ["| field | type | required | description |", "| --- | --- | --- | --- |"]
    required = schema.get("required") or []
    for n, s in (schema.get("properties") or {}).items():
        rows.append(f"| {n} | {kind(s) or 'any'} | {'yes' if n in required else 'no'} | {s.get('description', '')} |")
    return "\n".join(rows)


def document(service: dict) -> str:
    """Markdown for callers of a service."""
    given, made = service.get("inputSchema") or {}, service.get("outputSchema") or {}
    return "\n\n".join([f"# {service.get('displayName') or service['name']}", "## Input", field_table(given), "## Output", field_table(made), "## Example", f"```json\n{example(given)}\n```"])
