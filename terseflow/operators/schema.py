"""JSON and YAML schemas without the keys that only explain: description, default, examples."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.functions.classify import _no_constant
from terseflow.semantics import extension

REMOVED = frozenset({"description", "default", "examples"})
_ESCAPES = re.compile("[<>&  ]")


def _number(x: float) -> str:
    """Shortest decimal form of a 64-bit float, with an exponent below 1e-6 and from 1e21 on."""
    size = abs(x)
    if size and (size < 1e-6 or size >= 1e21):
        head, _, exponent = repr(x).partition("e")
        if not exponent:
            head, _, exponent = f"{x:.17e}".partition("e")
        return f"{head.removesuffix('.0')}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').zfill(2)}"
    return format(int(x), "d") if x == int(x) else repr(x) if "e" not in repr(x) else f"{x:.20f}".rstrip("0")


def _string(x: str) -> str:
    return _ESCAPES.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(x, ensure_ascii=False))


def _encoded(node: object) -> str:
    if isinstance(node, dict):
        return "{" + ",".join(f"{_string(k)}:{_encoded(v)}" for k, v in sorted(node.items()) if k not in REMOVED) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(_encoded, node)) + "]"
    if isinstance(node, str):
        return _string(node)
    if node is None or isinstance(node, bool):
        return {None: "null", True: "true", False: "false"}[node]
    return _number(float(node))


def minify_json(text: str) -> str:
    """Compact JSON with sorted keys; numbers go through 64-bit floats. ValueError for what is no JSON."""
    return _encoded(json.loads(text, parse_constant=_no_constant))


class Unsupported(ValueError):
    """A YAML feature that is refused."""


def minify_yaml(text: str) -> str:
    """YAML in its own order, nested by two blanks; comments are not kept. ValueError for what is refused or broken."""
    import yaml

    if "\t" in text:
        raise Unsupported("unsupported yaml feature: tabs")

    class Dumper(yaml.SafeDumper):
        def increase_indent(self, flow: bool = False, indentless: bool = False):  # noqa: ANN202, ARG002
            return super().increase_indent(flow, False)

    def prune(node: yaml.Node) -> None:
        if isinstance(node, yaml.MappingNode):
            if any(k.value == "<<" for k, _ in node.value):
                raise Unsupported("unsupported yaml feature: merge keys")
            node.value = [(k, v) for k, v in node.value if not (isinstance(k, yaml.ScalarNode) and k.value in REMOVED)]
            for _, v in node.value:
                prune(v)
        elif isinstance(node, yaml.SequenceNode):
            for v in node.value:
                prune(v)

    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for event in yaml.parse(text, Loader=loader):
            if isinstance(event, yaml.AliasEvent):
                raise Unsupported("unsupported yaml feature: aliases")
            if getattr(event, "anchor", None):
                raise Unsupported("unsupported yaml feature: anchors")
        root = next(yaml.compose_all(text, Loader=loader), None)
        if root is None:
            return ""
        prune(root)
        if isinstance(root, (yaml.MappingNode, yaml.SequenceNode)) and not root.value:
            return ""
        return yaml.serialize(root, Dumper=Dumper, indent=2, width=1 << 30, allow_unicode=True).strip().removesuffix("\n...")
    except yaml.YAMLError as bad:
        raise ValueError(f"yaml: {bad}") from bad


def minify(ext: str, text: str) -> tuple[str | None, str | None]:
    """(output, error)."""
    try:
        if ext == ".json":
            return minify_json(text), None
        if ext in (".yaml", ".yml"):
            return minify_yaml(text), None
        return None, f'unsupported schema extension "{ext}"'
    except (ValueError, RecursionError) as bad:
        return None, str(bad) if isinstance(bad, Unsupported) else f"invalid schema: {type(bad).__name__}"


@F.pandas_udf(T.StructType([T.StructField("output", T.StringType()), T.StructField("error", T.StringType())]))
def _minified(ext: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([minify(e, t) if t is not None else (None, "no content") for e, t in zip(ext, text)], columns=["output", "error"])


def minified(path: Column, text: Column) -> Column:
    """struct<output, error>."""
    return _minified(extension(path), text)


def minify_schema(docs: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    done = docs.withColumn("__tf_min", minified(F.col(path_col), F.col(text_col)))
    done = done.withColumn("output", F.col("__tf_min.output")).withColumn("error", F.col("__tf_min.error")).drop("__tf_min")
    return done.withColumn("changed", F.coalesce(F.col("output") != F.col(text_col), F.lit(False)))
