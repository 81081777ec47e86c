"""Texts of this library's own, as they come out whole, and how much shorter they must get in tokens."""

import json

import pytest
from pyspark.sql import functions as F

from terseflow.functions.metrics import approximate_tokens
from terseflow.operators import code, history, markdown, prose, schema

T = "`"


def saved(before, after):
    return 100 * (1 - approximate_tokens(after) / approximate_tokens(before))


PROSE = {
    "guide": (
        "Please note that you should always check the configuration in order to avoid surprises. However, due to the fact that the application is able to restart, you do not need to wait.\n",
        "check the config to avoid surprises. but because the app can restart, you don't need to wait.\n",
    ),
    "review": (
        "It is important to note that the implementation of the authentication documentation is basically, a number of notes. Make sure to keep the existing messages.\n",
        "the impl of the auth docs is many notes. keep existing msgs.\n",
    ),
    "prompt": ("Kindly make sure to simplify the following repositories. In the event that the database is not available, you can use the environment variables.\n", "simplify these repos. If the db isn't available, use env vars.\n"),
}


@pytest.mark.parametrize("name", PROSE)
def test_prose(name):
    text, short = PROSE[name]
    assert prose.compress_text(text) == short
    assert saved(text, short) >= 20


def test_prose_together():
    whole = "\n".join(a for a, _ in PROSE.values())
    assert saved(whole, prose.compress_text(whole)) >= 15


def test_markdown(spark):
    text = "# Title   \n\n\n\n* one   \n+ two\n\n\n|  a  |   b    |\n|  --- |  ---   |\n|  1   |   2    |   \n\n\n" + T * 3 + "\nx   \n\n\ny\n" + T * 3 + "\n\n\nend   "
    out = spark.createDataFrame([(text,)], "t string").select(markdown.optimized(F.col("t")).alias("o")).first().o
    assert out == "# Title\n\n- one\n- two\n\n|a|b|\n|---|---|\n|1|2|\n\n" + T * 3 + "\nx   \n\n\ny\n" + T * 3 + "\n\nend"
    assert saved(text, out) >= 5


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def test_schemas(spark):
    text = json.dumps({"type": "object", "title": "A long title", "description": "What this whole object is good for, at length", "properties": {"mode": {"type": "string", "description": "Which of the modes is to be used", "default": "safe", "enum": ["safe", "fast"], "examples": ["safe"]}, "n": {"type": "integer", "description": "How many of them there are"}}, "required": ["mode"]}, indent=4)
    out = one(spark, schema.minified(F.lit("a.json"), F.lit(text))).output
    left = json.loads(out)
    assert left["properties"]["mode"]["enum"] == ["safe", "fast"] and left["required"] == ["mode"] and "description" not in out and "examples" not in out
    assert saved(text, out) >= 40


def test_history(spark):
    noise = "\n".join(["FAIL the same line"] * 60)
    messages = [
        {"role": "user", "content": "look at it"},
        {"role": "tool", "toolName": "view", "filePath": "a.go", "content": "package old\n" * 20},
        {"role": "tool", "toolName": "bash", "content": noise},
        {"role": "tool", "toolName": "view", "filePath": "a.go", "content": "package main"},
        {"role": "assistant", "content": "done"},
    ]
    text = json.dumps(messages)
    frame = spark.createDataFrame([(1, text)], "id long, doc string")
    found = history.compact_history_json(frame, "id", "doc").first().asDict()
    out = next(v for k, v in found.items() if k not in ("id", "doc") and isinstance(v, str) and v.startswith("["))
    left = json.loads(out)
    assert [m["content"] for m in left] == ["look at it", "FAIL the same line x60", "package main", "done"]
    assert saved(text, out) >= 30


GO = 'package main\n\nimport (\n\t"fmt"\n)\n\n// Sum adds.\nfunc Sum(a, b int) int {\n\ttotal := a + b\n\tfor i := 0; i < 10; i++ {\n\t\ttotal += i * a\n\t\tfmt.Println(total, "}")\n\t}\n\treturn total\n}\n\nfunc (t *T) Name() string {\n\tif t == nil {\n\t\treturn "none" + fmt.Sprint(1, 2, 3)\n\t}\n\treturn t.name\n}\n'
TS = 'import { a, b } from "./m";\n\nexport function f(x: number): string {\n  const parts = [];\n  for (let i = 0; i < x; i++) {\n    parts.push(`${i}: ${a(i)} {`);\n  }\n  return parts.join(", ");\n}\n\nclass C {\n  run(y: string): void {\n    console.log(y, /[}]/.test(y), "more", "words", "in", "here");\n    if (y) {\n      return;\n    }\n  }\n}\n'


def test_skeletons():
    go, ts = code.skeleton(".go", GO)[0], code.skeleton(".ts", TS)[0]
    assert "func Sum(a, b int) int\n" in go and "func (t *T) Name() string\n" in go and "total" not in go
    assert "export function f(x: number): string;" in ts and "run(y: string): void;" in ts and "console" not in ts
    assert saved(GO + TS, go + ts) >= 60


def test_imports():
    lines = "".join(f'import {{ one{i}, two{i}, three{i}, four{i} }} from "./module{i}";\n' for i in range(8))
    text = lines + "\nexport const x = 1;\n"
    out = code.imports_lines(text)
    assert "export const x = 1;" in out and saved(text, out) >= 30
