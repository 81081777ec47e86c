"""Rules, zones, validation, markdown, schemas and code on small texts, without the reference's files."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terseflow.operators import code, prose, schema, validate, zones
from terseflow.plans.rules import PHASES, rewrite

T = "`"


def test_rule_table():
    assert [len(r) for r in PHASES.values()] == [30, 8, 14, 51, 8, 6, 16, 31]


@pytest.mark.parametrize(
    ("text", "short"),
    [
        ("Do not stop. You cannot.", "Don't stop. You can't."),
        ("you should always keep it", "keep it"),
        ("Please\nfoo", "foo"),
        ("you can not go", "not go"),
        ("Due to the fact that it is able to run", "Because it can run"),
        ("However, we wait", "but we wait"),
        ("Simply, go", "go"),
        ("As a reminder, the following config", "these config"),
        ("the applications and a language model", "the apps and a LLM"),
        ("éplease keep", "ékeep"),
        ("displease nobody", "displease nobody"),
    ],
)
def test_rewrites(text, short):
    assert rewrite(text) == short


def test_compress_keeps_zones():
    text = f"# Please keep\n\nPlease note that {T}do not{T} is  fine , see https://a.test/do%20not and /usr/do not.\n\n{T * 3}sh\ndo not\n{T * 3} tail\nmake sure to ensure tokens\n"
    out = prose.compress_text(text)
    assert out == f"# Please keep\n\n{T}do not{T} is fine, see https://a.test/do%20not and /usr/do not.\n\n{T * 3}sh\ndo not\n{T * 3} tail\nensure ensurekens\n"
    assert validate.compare(text, out) == ([], [])


def test_zone_kinds():
    text = f"intro ./a/b (/c)\n{T * 4}\n{T * 3}\n{T * 4}\n## H\n    # code\n> # quoted\n~~~\nx\n{T * 3}\n~~~\nend http://u.test)"
    found = zones.split(text)
    assert "".join(z for _, z in found) == text
    assert [(k, z) for k, z in found if k != "prose"] == [
        ("path", "./a/b"), ("path", "/c"), ("code_fence", f"{T * 4}\n{T * 3}\n{T * 4}\n"), ("heading", "## H\n"), ("code_fence", f"~~~\nx\n{T * 3}\n~~~\n"), ("url", "http://u.test"),
    ]
    assert zones.split("") == [] and zones.headings("# A\n## B c\n#no\n") == ["A", "B c"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#`~ >-ab/.:\n(ht)1", max_size=80))
def test_zones_concatenate(text):
    assert "".join(z for _, z in zones.split(text)) == text


def test_validation():
    a = f"# A\n{T * 3}\nx\n{T * 3}\nhttps://u.test /p\n- 1\n- 2\n- 3\n"
    assert validate.compare(a, a) == ([], [])
    assert validate.compare(a, a.replace("# A", "# B").replace("x", "y").replace("u.test", "v.test"))[0] == ["heading mismatch", "code block mismatch", "url mismatch"]
    assert validate.compare(a, a.replace("/p", "p").replace("- 3\n", ""))[1] == ["path mismatch", "bullet count drift"]


def test_json():
    text = json.dumps({"b": [{"description": 1, "x": "<é&>"}], "a": {"default": 0, "z": 1.0, "y": 1e21, "w": 1e-7, "v": -0.5}, "examples": []})
    assert schema.minify_json(text) == '{"a":{"v":-0.5,"w":1e-07,"y":1e+21,"z":1},"b":[{"x":"\\u003cé\\u0026\\u003e"}]}'
    assert schema.minify(".json", "[1] x") == (None, "invalid schema: JSONDecodeError")
    assert schema.minify(".toml", "")[1] == 'unsupported schema extension ".toml"'


def test_yaml():
    pytest.importorskip("yaml")
    text = "type: object\ndescription: d\nproperties:\n  m:\n    enum:\n    - a\n    - 'on'\n    default: a\nrequired: [m]\n"
    assert schema.minify_yaml(text) == "type: object\nproperties:\n  m:\n    enum:\n      - a\n      - 'on'\nrequired: [m]"
    assert schema.minify_yaml("description: x\n") == "" and schema.minify_yaml("") == "" and schema.minify_yaml("a: 'x & *y'") == "a: 'x & *y'"
    for bad, why in (("a:\t1", "tabs"), ("a: &x 1", "anchors"), ("<<: {a: 1}", "merge keys")):
        assert schema.minify(".yml", bad)[1] == f"unsupported yaml feature: {why}"


def test_script_skeleton():
    text = 'import a from "a";\nexport async function f(x: { a: number }): Promise<{ b: string }> {\n  return `}${x}`;\n}\n\nexport class C<T> extends B {\n  static n = () => { return 1; };\n  get(a = "{"): T {\n    if (a) { return 1 }\n  }\n}\nconst v = [1, 2];\nexport const g = (a) => {\n  return /[}]/.test(a);\n};\ntype S = "x" | "y";\n'
    out, warnings, error = code.skeleton(".ts", text)
    assert error is None and warnings == []
    for kept in ("export async function f(x: { a: number }): Promise<{ b: string }>;", "export class C<T> extends B {", "get(a = \"{\"): T;", "const v = [1, 2];", "export const g = (a) => {};", 'type S = "x" | "y";'):
        assert kept in out
    assert "return `" not in out and "test(a)" not in out
    broken = "export const b = ({ v }) => {\n  return v + ;\n};\n"
    assert code.skeleton(".tsx", broken) == (broken, [code.PARTIAL, code.HEURISTIC], None)
    assert code.skeleton_lines("export function f(a) {\n  if (a) {\n  }\n}\nlet b;\n\n") == "export function f(a);\n\nlet b;\n"


def test_markup_skeleton():
    text = 'export const W = ({ t }: P) => {\n  return <div>don\'t {t}</div>;\n};\n\nexport class S {\n  render(v: string): string {\n    return v.trim();\n  }\n}\n'
    out, warnings, _ = code.skeleton(".tsx", text)
    assert warnings == [] and "export const W = ({ t }: P) => {}" in out and "render(v: string): string;" in out and "don't" not in out


def test_go():
    text = 'package p\n\nimport (\n\t"fmt"\n\tq "a/b"\n)\n\n// F is kept.\nfunc (t *T) F(v interface{}, f func() error) (int, error) {\n\tfmt.Println("}", `{`, \'{\')\n\treturn 0, nil\n}\n\nvar h = func() { x() }\n'
    assert code.skeleton(".go", text)[0] == 'package p\n\nimport (\n\t"fmt"\n\tq "a/b"\n)\n\n// F is kept.\nfunc (t *T) F(v interface{}, f func() error) (int, error)\n\nvar h = func() { x() }\n'
    assert code.trim_imports_text(".go", text)[0].startswith("// imports: fmt; q=a/b\n\npackage p\n\n// F is kept.")
    assert code.skeleton(".go", "func f() {}")[2] and code.skeleton(".rb", "")[2] == 'unsupported skeleton extension ".rb"'


def test_script_imports():
    text = 'import React, {\n  useMemo,\n  useRef,\n} from "react";\nimport * as path from "node:path";\nimport "./poly";\nimport type { P } from "./t";\nimport { a, b, c, d } from "m";\n\nexport const x = 1;\n'
    assert code.trim_imports_text(".tsx", text) == ("// imports: react(React, useMemo, useRef); node:path(* as path); ./poly(side-effect); m{4}\n// types: P from ./t\n\nexport const x = 1;\n", [], None)
    out, found, error = code.reduce_file(".ts", 'import { a } from "m";\nfunction f() {\n  a();\n}\n')
    assert (out, found, error) == ("// imports: m(a)\n\nfunction f();\n", [], None)
