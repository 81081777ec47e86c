"""Source code reduced to signatures and import summaries.

A bracket scanner that knows strings, templates, comments and regular expressions walks the top level of a file. On any
doubt, JS and TS fall back to line heuristics and say so, and Go is an error.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.semantics import TICK, extension

SCRIPT_EXT = tuple(f".{x}" for x in "js jsx ts tsx".split())
PARTIAL = "partial parse, using heuristic fallback"
HEURISTIC = "heuristic skeleton used for non-Go source"
LISTED_NAMES = 3
_PAIRS = {"(": ")", "[": "]", "{": "}"}


#: All that the scanner stops at; what lies between is plain.
_SIGN = re.compile(f"[/\"'{TICK}()\\[\\]{{}}]")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|else|do|yield|await)\s*\Z")


class Doubt(ValueError):
    """The scanner can't follow the source."""


class Source:
    """A text whose strings and comments are known: `skip` maps the first character of each to the one after its last."""

    def __init__(self, text: str, go: bool = False, markup: bool = False) -> None:
        self.text, self.skip, self.close = text, {}, {}
        stack: list[int] = []
        at, last = 0, ""
        while at < len(text):
            sign = _SIGN.search(text, at)
            plain = text[at : sign.start() if sign else len(text)].rstrip()
            last = plain[-1] if plain else last
            if not sign:
                break
            at = sign.start()
            c = text[at]
            end = at + 1
            if text.startswith("//", at):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                self.skip[at] = end
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2) + 2
                if end < 2:
                    raise Doubt("unclosed comment")
                self.skip[at] = end
            elif c in "\"'" or (c == TICK and go):
                end = self._string(at, c, raw=c == TICK)
                if end < 0 and not markup:
                    raise Doubt("unclosed string")
                if end > 0:
                    self.skip[at] = end
                else:
                    end = at + 1  # an apostrophe in the text of an element
                last = c
            elif c == TICK:
                end = self._template(at)
                self.skip[at] = end
                last = c
            elif c == "/" and not go and (not last or last in "(,=:[!&|?{};+-*%~^" or _BEFORE_REGEX.search(text, max(0, at - 12), at)) and (m := _REGEX.match(text, at)):
                end = m.end()
                self.skip[at] = end
                last = "/"
            elif c in _PAIRS:
                stack.append(at)
                last = c
            elif c in ")]}":
                if not stack or _PAIRS[text[stack[-1]]] != c:
                    raise Doubt("unbalanced")
                self.close[stack.pop()] = at
                last = c
            else:
                last = c
            at = end
        if stack:
            raise Doubt("unbalanced")

    def _string(self, at: int, quote: str, raw: bool) -> int:
        i = at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\" and not raw:
                i += 1
            elif c == quote:
                return i + 1
            elif c == "\n" and not raw:
                return -1
            i += 1
        return -1

    def _template(self, at: int) -> int:
        i, depth = at + 1, 0
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif self.text.startswith("${", i):
                depth += 1
                i += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == TICK and not depth:
                return i + 1
            i += 1
        raise Doubt("unclosed template")

    def step(self, at: int) -> int:
        """The next place on the same level."""
        if at in self.skip:
            return self.skip[at]
        return self.close[at] + 1 if at in self.close else at + 1

    def blank(self, at: int) -> int:
        """Past white space and comments."""
        while at < len(self.text) and (self.text[at].isspace() or (at in self.skip and self.text[at] == "/" and self.text[at + 1] in "/*")):
            at = self.step(at)
        return at

    def body_after(self, at: int) -> int:
        """The '{' of a body behind parameters that end before `at`, past a result type; -1 if there is none."""
        before = ")"
        while at < len(self.text):
            at = self.blank(at)
            if at >= len(self.text) or self.text[at] in ";=":
                if self.text.startswith("=>", at):
                    before, at = "=>", at + 2
                    continue
                return -1
            if self.text[at] == "{":
                if before not in (":", "|", "&", "<", ",", "=>"):
                    return at
                at, before = self.close[at] + 1, "}"
                continue
            before = self.text[at]
            at = self.step(at)
        return -1


_FUNCTION = re.compile(r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*\w*\s*")
_CLASS = re.compile(r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\b")
_ARROW = re.compile(r"(?:export\s+)?(?:const|let)\s+\w+[^=]*=\s*(?:async\s*)?")
_BROKEN = re.compile(r"(?:[^+\-\s]\s*|\s)[+\-*/%&|^=]\s*[;)\]]")


def _generic(src: Source, at: int) -> int:
    """Past <...>."""
    if src.text[at : at + 1] != "<":
        return at
    depth = 0
    while at < len(src.text):
        c = src.text[at]
        depth += (c == "<") - (c == ">" and src.text[at - 1] != "=")
        at = src.step(at)
        if not depth:
            return at
    raise Doubt("unclosed type parameters")


def _class_body(src: Source, begin: int, end: int) -> str:
    out, at, member, value = [], begin + 1, begin + 1, False
    kept = begin
    while at < end:
        c = src.text[at]
        if at in src.skip:
            at = src.skip[at]
        elif c == "(" and not value and re.search(r"[\w$\]>#\"']\s*$", src.text[member:at]):
            body = src.body_after(src.close[at] + 1)
            if 0 <= body < end:
                out.append(src.text[kept:body].rstrip() + ";")
                at = kept = member = src.close[body] + 1
            else:
                at = src.close[at] + 1
        elif c == "=" and src.text[at + 1] not in "=>":
            value, at = True, at + 1
        elif c in ";\n":
            value = value and c == "\n" and src.text[src.blank(at)] in ".+-*/?:&|"
            at += 1
            member = at
        else:
            at = src.step(at)
    return "".join(out) + src.text[kept : end + 1]


def _expression_end(src: Source, at: int) -> int:
    while at < len(src.text):
        if src.text[at] == ";":
            return at
        if src.text[at] == "\n":
            nxt = src.blank(at)
            if nxt >= len(src.text) or src.text[nxt] not in ".+-*/?:&|,=<":
                return at
        at = src.step(at)
    return at


def skeleton_script(text: str, markup: bool) -> str:
    """TS or JS without the bodies of top-level functions, methods and arrow functions."""
    src = Source(text, markup=markup)
    plain = list(text)
    for a, b in src.skip.items():
        plain[a:b] = "x" * (b - a) if text[a] != "/" or text[a + 1] not in "/*" else " " * (b - a)
    if _BROKEN.search("".join(plain).replace("++", "xx").replace("--", "xx")):
        raise Doubt("operator without operand")
    out, at, kept = [], 0, 0
    while (at := src.blank(at)) < len(text):
        if m := _FUNCTION.match(text, at):
            params = _generic(src, m.end())
            body = src.body_after(src.close[params] + 1) if text[params : params + 1] == "(" else -1
            if body >= 0:
                out.append(text[kept:body].rstrip() + ";")
                at = kept = src.close[body] + 1
                continue
        elif m := _CLASS.match(text, at):
            body = m.end()
            while body < len(text) and text[body] != "{":
                body = src.step(body)
            if body in src.close:
                out.append(text[kept:body] + _class_body(src, body, src.close[body]))
                at = kept = src.close[body] + 1
                continue
        elif m := _ARROW.match(text, at):
            params = _generic(src, m.end())
            arrow = src.close[params] + 1 if params in src.close and text[params] == "(" else params + len(re.match(r"\w*", text[params:])[0])
            while arrow < len(text) and text[arrow] not in ";\n" and not text.startswith("=>", arrow):
                arrow = src.step(arrow)
            if text.startswith("=>", arrow):
                body = src.blank(arrow + 2)
                end = src.close[body] + 1 if text[body : body + 1] == "{" else _expression_end(src, body)
                out.append(text[kept:arrow] + "=> {}")
                at = kept = end
                continue
        # to the end of the statement
        while at < len(text) and text[at] not in ";\n":
            at = src.step(at)
        at += 1
    return "".join(out) + text[kept:]


_SIGNATURE = re.compile(r"(?:export\b\s+)?(?:async\b\s+)?function\b\s+\w.*\{$", re.A)


def skeleton_lines(text: str) -> str:
    """The line heuristic: bodies of 'function' lines by brace depth, with a blank line in their place."""
    out, depth, inside = [], 0, False
    for line in text.split("\n"):
        change = line.count("{") - line.count("}")
        if inside:
            depth += change
            if depth <= 0:
                inside = False
                out.append("")
        elif _SIGNATURE.match(line.strip()):
            out.append(line.strip().removesuffix("{").strip() + ";")
            inside, depth = True, change
        else:
            out.append(line)
    return "\n".join(out).rstrip("\n") + "\n"


def skeleton_go(text: str) -> str:
    """Go without function bodies; the rest stays as it is written. Doubt for what is no Go file."""
    src = Source(text, go=True)
    at = src.blank(0)
    if not re.match(r"package\s+\w+", text[at:]):
        raise Doubt("expected 'package'")
    out, kept = [], 0
    while (at := src.blank(at)) < len(text):
        if re.match(r"func\b", text[at:]):
            while at < len(text) and text[at] != "\n":
                if text[at] == "{" and not re.search(r"\b(?:interface|struct)\s*$", text[kept:at]):
                    out.append(text[kept:at].rstrip())
                    at = kept = src.close[at] + 1
                    break
                at = src.step(at)
        else:
            while at < len(text) and text[at] != "\n":
                at = src.step(at)
    return "".join(out) + text[kept:]


def skeleton(ext: str, text: str) -> tuple[str | None, list[str], str | None]:
    """(output, warnings, error)."""
    if ext == ".go":
        try:
            return skeleton_go(text), [], None
        except (Doubt, KeyError, IndexError) as bad:
            return None, [], f"go parse: {bad}"
    if ext in SCRIPT_EXT:
        try:
            return skeleton_script(text, ext.endswith("x")), [], None
        except (Doubt, KeyError, IndexError):
            return skeleton_lines(text), [PARTIAL, HEURISTIC], None
    return None, [], f'unsupported skeleton extension "{ext}"'


# -- imports -------------------------------------------------------------------------------------------------------


def name_list(names: str) -> list[str]:
    return [x.strip() for x in names.split(",") if x.strip()]


def import_summary(module: str, names: list[str]) -> str:
    return f"{module}({', '.join(names)})" if len(names) <= LISTED_NAMES else f"{module}{{{len(names)}}}"


def _with_summaries(imports: list[str], types: list[str], body: str) -> str:
    lines = [f"// {kind}: {'; '.join(found)}\n" for kind, found in (("imports", imports), ("types", types)) if found]
    return "".join(lines) + ("\n" if lines else "") + body


_IMPORT = re.compile(r"""import\b\s*(?:(?P<type>type\s+(?!from\b|,))?(?P<clause>[^"';]*?)\s*\bfrom\s*)?["'](?P<module>[^"'\n]*)["'][^\S\n]*;?""")


def imports_script(text: str, markup: bool) -> str:
    """Import statements of a TS or JS file as one summary line, those of types as another."""
    src = Source(text, markup=markup)
    imports, types, body, at, kept = [], [], [], 0, 0
    while (at := src.blank(at)) < len(text):
        m = _IMPORT.match(text, at)
        if not m:
            if re.match(r"import\s+[\w{*]", text[at:]):
                raise Doubt("import")
            while at < len(text) and text[at] not in ";\n":
                at = src.step(at)
            at += 1
            continue
        body.append(text[kept:at].rstrip())
        at = kept = m.end()
        clause = m["clause"] or ""
        names = name_list(re.sub(r"\{[^}]*\}", "", clause)) + [n for group in re.findall(r"\{([^}]*)\}", clause) for n in name_list(group)]
        if m["type"]:
            if names:
                types.append(f"{', '.join(names)} from {m['module']}")
        else:
            imports.append(import_summary(m["module"], names) if names else f"{m['module']}(side-effect)")
    body.append(text[kept:])
    return _with_summaries(imports, types, "".join(body).lstrip("\r\n"))


_NAMED_LINE = re.compile(r"""import\s+(?P<type>type\s+)?\{(?P<names>[^{}]+)\}\s*\bfrom\s+["'](?P<module>[^"']+)["'];?$""")


def imports_lines(text: str) -> str:
    """The line heuristic: named imports that stand on one line."""
    imports, types, body = [], [], []
    for line in text.split("\n"):
        m = _NAMED_LINE.match(line.strip())
        if not m:
            body.append(line)
        elif m["type"]:
            types.append(f"{', '.join(name_list(m['names']))} from {m['module']}")
        else:
            imports.append(import_summary(m["module"], name_list(m["names"])))
    return _with_summaries(imports, types, "\n".join(body))


_GO_SPEC = re.compile(r"""(?:([\w.]+)[ \t]+)?(?:"([^"\n]*)"|`([^`]*)`)""")


def imports_go(text: str) -> str:
    src = Source(text, go=True)
    at = src.blank(0)
    if not re.match(r"package\s+\w+", text[at:]):
        raise Doubt("expected 'package'")
    found, body, kept = [], [], 0
    while (at := src.blank(at)) < len(text):
        begin = at
        m = re.match(r"import\b\s*", text[at:])
        if m:
            at += m.end()
            if text[at : at + 1] == "(":
                end = src.close[at] + 1
                inner = re.sub(r"//[^\n]*", "", text[at + 1 : end - 1])
            else:
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                inner = text[at:end]
            found += [f"{a}={b or c}" if a else b or c for a, b, c in _GO_SPEC.findall(inner)]
            body.append(text[kept:begin])
            at = kept = end
        while at < len(text) and text[at] != "\n":
            at = src.step(at)
    body.append(text[kept:])
    rest = re.sub(r"\n{3,}", "\n\n", "".join(body))
    return f"// imports: {'; '.join(found)}\n\n{rest}" if found else rest


def trim_imports_text(ext: str, text: str) -> tuple[str | None, list[str], str | None]:
    """(output, warnings, error)."""
    if ext == ".go":
        try:
            return imports_go(text), [], None
        except (Doubt, KeyError, IndexError) as bad:
            return None, [], f"go parse: {bad}"
    if ext in SCRIPT_EXT:
        try:
            return imports_script(text, ext.endswith("x")), [], None
        except (Doubt, KeyError, IndexError):
            return imports_lines(text), [PARTIAL], None
    return None, [], f'unsupported import trimming extension "{ext}"'


def reduce_file(ext: str, text: str) -> tuple[str | None, list[str], str | None]:
    """Imports summarised, where that works, and then the skeleton."""
    output, warnings, error = trim_imports_text(ext, text)
    if error:
        output, warnings = text, []
    result, more, error = skeleton(ext, output)
    return result, [] if error else warnings + more, error


_RESULT = T.StructType([T.StructField("output", T.StringType()), T.StructField("findings", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def _udf(of):  # noqa: ANN001, ANN202
    @F.pandas_udf(_RESULT)
    def run(ext: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [of(e, t) if t is not None else (None, [], "no content") for e, t in zip(ext, text)]
        return pd.DataFrame(rows, columns=["output", "findings", "error"])

    return run


_skeleton, _imports, _reduce = _udf(skeleton), _udf(trim_imports_text), _udf(reduce_file)


def skeletons(path: Column, text: Column) -> Column:
    """struct<output, findings, error>, as are the next two."""
    return _skeleton(extension(path), text)


def trimmed_imports(path: Column, text: Column) -> Column:
    return _imports(extension(path), text)


def reduced_files(path: Column, text: Column) -> Column:
    return _reduce(extension(path), text)


def with_result(docs: DataFrame, result: Column) -> DataFrame:
    return docs.withColumn("__tf_r", result).select(*docs.columns, "__tf_r.*")
