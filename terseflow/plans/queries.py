"""The registered queries of the reference's operators and the SQL that each must equal, over whole tables.

The test tables hold no markdown, rules or code, so these queries make their inputs from columns. Text is spelled once,
as a Pick or a join of parts, and rendered for both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terseflow.functions import classify, metrics
from terseflow.operators import code, corpus, dedup, history, markdown, prose, runs, schema, validate, zones
from terseflow.plans.rules import PHASES
from terseflow.semantics import TICK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Pick:
    """One of several texts, by a whole-number column: number `column // every % len(texts)`."""

    column: str
    texts: tuple[str, ...]
    every: int = 1

    @property
    def spark(self) -> Column:
        n = (F.floor(F.col(self.column) / self.every) % len(self.texts)).cast("int")
        return F.element_at(F.array(*map(F.lit, self.texts)), n + 1)

    @property
    def sql(self) -> str:
        return f"([{', '.join(map(quoted, self.texts))}])[({self.column} // {self.every}) % {len(self.texts)} + 1]"


@dataclass(frozen=True)
class Text:
    """Fixed strings, Picks and (as 1-tuples) column names, one after another."""

    parts: tuple

    @property
    def spark(self) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.col(p[0]).cast("string") if isinstance(p, tuple) else p.spark for p in self.parts])

    @property
    def sql(self) -> str:
        return " || ".join(quoted(p) if isinstance(p, str) else f"{p[0]}::VARCHAR" if isinstance(p, tuple) else f"({p.sql})" for p in self.parts)


# -- metrics -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def measure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", metrics.bytes_of(text).alias("n_bytes"), metrics.word_count(text).alias("n_words"))


#: The approximation of tokens over text parts: words, numbers of up to three digits, signs, white space.
_BLANKS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
_PIECES = rf"(?i)'(?:[sdmt]|ll|ve|re)|[\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}{{1,3}}|[^\p{{L}}\p{{N}}_{_BLANKS}]+|[{_BLANKS}]+"


def tokens_sql(text: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(regexp_extract_all({text}, {quoted(_PIECES)}), lambda p: CASE WHEN regexp_full_match(p, {quoted(f'[{_BLANKS}]+')}) THEN contains(p, chr(10))::BIGINT "
        rf"WHEN regexp_matches(p, '^[\p{{L}}\p{{Nl}}\p{{No}}]') THEN 1 + greatest(0, strlen(p) - 2) // 6 WHEN regexp_matches(p, '^\p{{Nd}}') THEN 1 ELSE (strlen(p) + 2) // 3 END)), 0)::BIGINT"
    )


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {tokens_sql('text')} END AS n_tokens, 'approximate' AS backend FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", metrics.token_counts(F.col("text")).alias("n_tokens"), F.lit(metrics.token_backend()).alias("backend"))


@query("SELECT o_orderkey, CASE WHEN strlen(o_comment) > 0 THEN (strlen(o_comment) - strlen(o_orderpriority)) * 100.0::DOUBLE / strlen(o_comment) END AS percent FROM (SELECT o_orderkey, o_orderpriority, o_orderpriority || o_orderstatus AS o_comment FROM orders)")
def reduction_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = metrics.bytes_of(F.concat("o_orderpriority", "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.reduction_percent(before, metrics.bytes_of(F.col("o_orderpriority"))).alias("percent"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(0, 101), lambda i: strlen(left(text, i)) <= 100))::INT) || chr(10) || '... [truncated ' || (strlen(text) - 100) || ' bytes] ...' END AS payload FROM documents")
def payload_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", metrics.truncated(F.col("text"), 100).alias("payload"))


# -- classification ------------------------------------------------------------------------------------------------

PATHS = Text((Pick("o_orderkey", ("docs/", "/home/u/.ssh/", "src/../", "a/b/", "./", ".aws/x/")), Pick("o_orderkey", ("note", "credentials", ".env", "main", "v1.2/plan"), 6), Pick("o_orderkey", (".md", ".go", ".yaml", "", ".bin", ".tsx", ".txt", ".py"), 7)))
CONTENTS = Pick("o_orderkey", ('{"a": [1, 2]}', "key: value\nother", "# a: b\nplain words", "package main\n\nfunc main() {}", "  \n ", "just prose here", "# title\n\nimport os", "class A", "[1, 2", "\n\n  def f(x)"))
_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$')"
_BY_EXT = f"CASE WHEN {_EXT} IN ('.md', '.txt') THEN 'natural_language' WHEN {_EXT} IN ('.go', '.java', '.js', '.jsx', '.py', '.rb', '.rs', '.ts', '.tsx') THEN 'code' WHEN {_EXT} IN ('.json', '.toml', '.yaml', '.yml') THEN 'config' WHEN {_EXT} <> '' THEN 'skip' END"
_BY_TEXT = r"CASE WHEN json_valid(content) THEN 'config' WHEN len(list_filter(string_split(content, chr(10)), lambda x: trim(x) NOT LIKE '#%' AND contains(x, ':'))) > 0 THEN 'config' WHEN regexp_matches(content, '(?m)^\s*(?:(?:class|def|func|package)\s+\w+|(?:export|import)\s+.+)') THEN 'code' WHEN regexp_replace(content, '\s', '', 'g') = '' THEN 'skip' ELSE 'natural_language' END"
_FILES = f"(SELECT o_orderkey, {PATHS.sql} AS path, {CONTENTS.sql} AS content FROM orders)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", PATHS.spark.alias("path"), CONTENTS.spark.alias("content"))


@query(f"SELECT o_orderkey, path, coalesce({_BY_EXT}, {_BY_TEXT}) AS kind FROM {_FILES}")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", "path", classify.classification(F.col("path"), F.col("content")).alias("kind"))


@query(f"SELECT o_orderkey, {_BY_EXT} AS kind FROM {_FILES}")
def classify_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", classify.by_extension(F.col("path")).alias("kind"))


@query(f"SELECT o_orderkey, {_BY_TEXT} AS kind FROM {_FILES}")
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", classify.by_content(F.col("content")).alias("kind"))


@query(f"SELECT o_orderkey, regexp_matches(path, '(^|/)\\.(ssh|aws|gnupg|kube)/') OR regexp_matches(path, '(^|/)(\\.env|\\.env\\.local|id_rsa|id_ed25519|credentials|known_hosts|authorized_keys)$') AS sensitive FROM {_FILES}")
def sensitive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", classify.is_sensitive_path(F.col("path")).alias("sensitive"))


@query(r"SELECT o_orderkey, len(list_filter(regexp_split_to_array(path, '[/\\]'), lambda x: x IN ('.ssh', '.aws', '.gnupg', '.kube'))) > 0 OR regexp_matches(path, '(^|[/\\])(\.env|\.env\.local|id_rsa|id_ed25519|credentials|known_hosts|authorized_keys)$') AS sensitive FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'C:\' || replace(path, '/', '\') ELSE path END AS path FROM " + _FILES + ")")
def sensitive_tool_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as tools report them: both kinds of slashes part names."""
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("C:\\"), F.replace("path", F.lit("/"), F.lit("\\")))).otherwise(F.col("path"))
    return files(spark, sf_dir).select("o_orderkey", classify.is_sensitive_path(path, backslashes=True).alias("sensitive"))


@query("SELECT doc_id, strlen(text) >= 10240 AND strlen(text) - strlen(replace(text, ' ', '')) >= 200 AS large FROM documents")
def large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks stand for newlines, of which the table has few."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.is_large_file(F.translate("text", " \n", "\n ")).alias("large"))


@query("SELECT l_orderkey, l_linenumber, (l_suppkey % 9 <> 0) AND CASE WHEN l_suppkey % 9 = 0 THEN -1 ELSE l_partkey % 500 END - l_suppkey % 100 BETWEEN 1 AND 199 AS targeted FROM lineitem")
def targeted_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("l_suppkey") % 9 == 0, -1).otherwise(F.col("l_partkey") % 500)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", classify.is_targeted_read(F.col("l_suppkey") % 100, end).alias("targeted"))


PROMPTS = Text((Pick("turn", ("Please Read  the file", "fix the test", "what does\nthis do", "look   at it", "show me more", "thread it", "explore and build", "I understand"), 1), " ", ("conv_id",)))
_INTENT = f"NOT regexp_matches(p, '(?i)\\b({'|'.join(classify.ACT_WORDS)})\\b') AND regexp_matches(p, '(?i)\\b({'|'.join(classify.READ_WORDS)})\\b')"
_PROMPTS = f"(SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, regexp_replace({PROMPTS.sql}, '\\s+', ' ', 'g') AS p FROM conversations))"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.has_read_intent(PROMPTS.spark).alias("intent"))


@query(f"SELECT * FROM {_PROMPTS}")
def read_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir)


@query(f"SELECT conv_id, turn, intent, intent AND NOT coalesce(lag(intent) OVER (PARTITION BY conv_id ORDER BY turn), false) AS nudge FROM {_PROMPTS}")
def nudge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.first_of_run(prompts(spark, sf_dir), "intent", "conv_id", "turn")


# -- prose ---------------------------------------------------------------------------------------------------------

_PHRASES = tuple(r.phrase if r.phrase[0] != "[" else r.phrase[2 if i % 2 else 1] + r.phrase[4:] for rules in PHASES.values() for i, r in enumerate(rules))
SENTENCES = Text(("Order ", ("o_orderkey",), ": ", Pick("o_orderkey", _PHRASES), ",  we ", Pick("o_orderkey", _PHRASES[::-1]), " . ", Pick("o_orderkey", ("", "x", "\n", "\t")), Pick("o_orderkey", _PHRASES, 5), " , end"))


def _phase_query(phase: str) -> None:
    rewritten = reduce(lambda x, r: f"regexp_replace({x}, {quoted(r.re2)}, {quoted(r.replacement)}, 'g')", PHASES[phase], "t")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, "orders").select("o_orderkey", SENTENCES.spark.alias("rewritten"))
        return prose.phase_by_lines(found, "rewritten", phase)

    run.__name__ = f"phase_{phase.replace('-', '_')}"
    query(f"SELECT o_orderkey, {rewritten} AS rewritten FROM (SELECT o_orderkey, {SENTENCES.sql} AS t FROM orders)")(run)


for _phase in PHASES:
    _phase_query(_phase)


@query(f"SELECT o_orderkey, replace(regexp_replace(regexp_replace({SENTENCES.sql}, '[ \\t]{{2,}}', ' ', 'g'), '[\\t\\f\\r ]+([.,;:!?])', '\\1', 'g'), 'ensure to', 'ensure') AS tidied FROM orders")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", prose.tidied(SENTENCES.spark).alias("tidied"))


_MD_LINES = ("# Order", "* star  bullet ", "  + plus", "| a |  b | c |", "", "", "  ", "plain text  ", TICK * 3, "~~~sh", "see https://x.test/a?b=1 and /etc/hosts", "- kept", "\tindented", "Please note that " + TICK + "code  x" + TICK + " is in order to test")
MARKDOWN = Text(tuple(p for i in range(9) for p in ((Pick("o_orderkey", _MD_LINES, 3**i), "\n") if i < 8 else (Pick("o_orderkey", _MD_LINES, 7),))))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("docs/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), MARKDOWN.spark.alias("content"))


_PAPERS = f"(SELECT o_orderkey, {MARKDOWN.sql} AS content FROM orders)"


_BLOCKS = ("# Head of it", TICK * 3 + "sh\ncode  x # no\n" + TICK * 3, "plain words here", "see https://x.test/a?b=1 now", "open /etc/hosts then", "run " + TICK + "code x" + TICK + " twice", "~~~\ny /a/b\n~~~", "", "a /var/log and http://u.test/c too")
BLOCKS = Text(tuple(p for i in range(6) for p in ((Pick("o_orderkey", _BLOCKS, 5**i), "\n") if i < 5 else (Pick("o_orderkey", _BLOCKS, 3),))))
_ZONE = f"(?m)(^{TICK * 3}[^\\n]*\\n(?:[^\\n]*\\n)*?{TICK * 3}\\n?|^~~~[^\\n]*\\n(?:[^\\n]*\\n)*?~~~\\n?|^#[^\\n]*\\n?|{TICK}[^{TICK}\\n]+{TICK}|https?://[^\\s)]+|/[a-z]+/[a-z]+)"


@query(
    f"""SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1)::INTEGER AS pos, CASE WHEN i % 2 = 1 THEN 'prose' WHEN text LIKE '{TICK * 3}%' OR text LIKE '~~~%' THEN 'code_fence' WHEN text LIKE '#%' THEN 'heading' WHEN text LIKE '{TICK}%' THEN 'inline_code' WHEN text LIKE 'http%' THEN 'url' ELSE 'path' END AS kind, text
FROM (SELECT o_orderkey, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS text FROM (SELECT o_orderkey, string_split(regexp_replace({BLOCKS.sql}, {quoted(_ZONE)}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM orders)) WHERE text <> ''"""
)
def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of documents whose fences close; zone_split takes those whose don't."""
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(zones.zones(BLOCKS.spark)).alias("pos", "z"))
    return found.select("o_orderkey", "pos", "z.kind", "z.text")


@query()
def zone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("o_orderkey", F.posexplode(zones.zones("content")).alias("pos", "z")).select("o_orderkey", "pos", "z.kind", "z.text")


@query()
def compress_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.compress(papers(spark, sf_dir)).select("o_orderkey", "output", "changed", "findings", "error", "stats.*")


# -- validation ----------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, regexp_extract_all(content, 'https?://[^\\s)]+') AS urls FROM {_PAPERS}")
def validate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("o_orderkey", validate.urls(F.col("content")).alias("urls"))


@query(f"SELECT o_orderkey, regexp_extract_all(content, '(?:^|[\\s(])((?:\\.?/|\\../)[^\\s)`]+)', 1) AS paths FROM {_PAPERS}")
def validate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("o_orderkey", validate.paths(F.col("content")).alias("paths"))


_BULLETS = "len(regexp_extract_all({}, '(?m)^\\s*[-*+]\\s+'))"
_CUT = "replace(content, '* star', 'star')"


@query(f"SELECT o_orderkey, b > 0 AND abs(b - a) / CASE WHEN b > 0 THEN b END::DOUBLE > 0.15 AS drift FROM (SELECT o_orderkey, {_BULLETS.format('content')} AS b, {_BULLETS.format(_CUT)} AS a FROM {_PAPERS})")
def bullet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("o_orderkey", F.coalesce(validate.bullet_drift(F.col("content"), F.replace("content", F.lit("* star"), F.lit("star"))), F.lit(False)).alias("drift"))


@query()
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = papers(spark, sf_dir)
    changed = docs.withColumn("content", F.when(F.col("o_orderkey") % 3 == 0, F.replace("content", F.lit("https"), F.lit("http"))).when(F.col("o_orderkey") % 3 == 1, F.replace("content", F.lit("* star"), F.lit("star"))).otherwise(F.col("content")))
    return validate.validate(docs, changed).select("path", "report.*")


_FENCES = quoted(f"(?m)^{TICK * 3}[^\\n]*\\n(?:[^\\n]*\\n)*?{TICK * 3}\\n?|^~~~[^\\n]*\\n(?:[^\\n]*\\n)*?~~~\\n?")
_LISTS = {
    "heading mismatch": "regexp_extract_all({}, '(?m)^# ([^\\n]*)', 1)",
    "code block mismatch": "regexp_extract_all({}, " + _FENCES.replace("{", "{{").replace("}", "}}") + ")",
    "url mismatch": "regexp_extract_all({}, 'https?://[^\\s)]+')",
    "path mismatch": "regexp_extract_all({}, '(?:^|[\\s(])((?:\\.?/|\\../)[^\\s)`]+)', 1)",
}
_DIFFER = {k: f"CASE WHEN {v.format('a')} <> {v.format('b')} THEN '{k}' END" for k, v in _LISTS.items()}
_EDITS = (("https", "http"), ("# Head", "# Tail"), ("code  x", "code y"), ("/etc/hosts", "/etc/host"), ("plain", "plainer"))


@query(
    f"""SELECT path, len(errors) = 0 AS valid, errors, warnings FROM (SELECT 'b' || o_orderkey AS path, list_filter([{", ".join(v for k, v in _DIFFER.items() if k != "path mismatch")}], lambda x: x IS NOT NULL) AS errors, list_filter([{_DIFFER["path mismatch"]}], lambda x: x IS NOT NULL) AS warnings
FROM (SELECT o_orderkey, a, CASE o_orderkey % 5 {" ".join(f"WHEN {i} THEN replace(a, {quoted(x)}, {quoted(y)})" for i, (x, y) in enumerate(_EDITS))} END AS b FROM (SELECT o_orderkey, {BLOCKS.sql} AS a FROM orders)))"""
)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on documents whose fences close, each with one kind of edit."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("path"), BLOCKS.spark.alias("content"))
    edited = reduce(lambda c, e: F.when(F.col("o_orderkey") % 5 == e[0], F.replace("content", F.lit(e[1][0]), F.lit(e[1][1]))).otherwise(c), enumerate(_EDITS), F.col("content"))
    return validate.validate(docs, docs.withColumn("content", edited)).select("path", "report.*")


# -- markdown ------------------------------------------------------------------------------------------------------

_MD_SQL = f"""
WITH l AS (SELECT o_orderkey, u.i AS pos, u.line FROM (SELECT o_orderkey, string_split(content, chr(10)) AS ls FROM {_PAPERS}) d, LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i) u),
m AS (SELECT *, trim(line, E' \\t') AS flat, substr(trim(line, E' \\t'), 1, 3) IN ('{TICK * 3}', '~~~') AS mark FROM l),
f AS (SELECT *, sum(mark::INT) OVER (PARTITION BY o_orderkey ORDER BY pos) % 2 = 1 AND NOT mark AS inside FROM m),
b AS (SELECT *, NOT mark AND NOT inside AND flat = '' AS blank FROM f),
k AS (SELECT *, blank AND coalesce(lag(blank) OVER (PARTITION BY o_orderkey ORDER BY pos), false) AS again FROM b),
c AS (SELECT o_orderkey, pos, CASE WHEN mark THEN rtrim(line, E' \\t') WHEN inside THEN line WHEN blank THEN ''
  WHEN flat LIKE '|%' AND flat LIKE '%|' THEN array_to_string(list_transform(string_split(flat, '|'), lambda x: trim(x, E' \\t')), '|')
  WHEN substr(flat, 1, 2) IN ('* ', '+ ') THEN '- ' || trim(substr(flat, 3), E' \\t') ELSE rtrim(line, E' \\t') END AS line FROM k WHERE NOT again)
SELECT o_orderkey, string_agg(line, chr(10) ORDER BY pos) AS output FROM c GROUP BY o_orderkey"""


@query(_MD_SQL)
def optimize_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("o_orderkey", markdown.optimized(F.col("content")).alias("output"))


@query(_MD_SQL)
def optimize_md_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.optimize_markdown(papers(spark, sf_dir), "o_orderkey", "content").select("o_orderkey", "output")


@query("SELECT doc_id, array_to_string(list_transform(string_split('| ' || replace(text, chr(10), ' | ') || ' |', '|'), lambda x: trim(x)), '|') AS row FROM documents")
def table_row_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), F.replace("text", F.lit("\n"), F.lit(" | ")), F.lit(" |"))
    return table(spark, sf_dir, "documents").select("doc_id", markdown.compact_row(row).alias("row"))


# -- schemas and code ----------------------------------------------------------------------------------------------

SCHEMAS = Text(('{"type": "object", "description": "d ', ("o_orderkey",), '", "properties": {"mode": {"default": 1, "enum": ["', Pick("o_orderkey", ("safe", "fast", "é<b>")), '", 2.50, ', ("o_orderkey",), '], "examples": []}, "a": null}, "required": [true]}'))
_YAML = Text(("type: object\ndescription: text ", ("o_orderkey",), "\nproperties:\n  mode:\n    default: safe\n    enum:\n      - ", Pick("o_orderkey", ("safe", "fast", "'on'", "1.0")), "\n", Pick("o_orderkey", ("", "x: &a 1\n", "\ty: 1\n", "z: *b\n", "examples:\n  - 1\n"))))


@query(f"""SELECT o_orderkey, '{{"properties":{{"a":null,"mode":{{"enum":["' || replace(replace({Pick("o_orderkey", ("safe", "fast", "é<b>")).sql}, '<', '\\u003c'), '>', '\\u003e') || '",2.5,' || o_orderkey || ']}}}},"required":[true],"type":"object"}}' AS output FROM orders""")
def minify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", schema.minified(F.lit("a.json"), SCHEMAS.spark)["output"].alias("output"))


@query()
def minify_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", schema.minified(F.lit("a.yml"), _YAML.spark).alias("r")).select("o_orderkey", "r.*")


_NAMES = ("a", "a, b as c", " x ,, y, z", "p, q, r, s")
SCRIPTS = Text(("import { ", Pick("o_orderkey", _NAMES), ' } from "./m', ("o_orderkey",), '";\nimport type { T } from "./t";\n\nexport function f', ("o_orderkey",), "(x: T): { n: number } {\n  return { n: ", Pick("o_orderkey", ("1", "x.n", "'}'", "/[}]/.test('') ? 1 : 2")), " };\n}\n\nclass C {\n  size = 1;\n  get(a) {\n    return a;\n  }\n}\nexport const g = async (y) => y + 1;\n"))
GO = Text(('package main\n\nimport (\n\t"fmt"\n\tq "x/y"\n)\n\n// F', ("o_orderkey",), " prints.\nfunc F", ("o_orderkey",), "(v interface{}) error {\n\tfmt.Println(", Pick("o_orderkey", ("v", '"}"', "`{`", "'{'")), ")\n\treturn nil\n}\n\ntype T struct {\n\tn int\n}\n"))


@query(
    f"""SELECT o_orderkey, 'a.ts' AS path, '// imports: ./m' || o_orderkey || CASE WHEN len(ns) <= 3 THEN '(' || array_to_string(ns, ', ') || ')' ELSE '{{' || len(ns) || '}}' END || E'\\n// types: T from ./t\\n\\n' || split_part(t, E'"./t";\\n', 2) AS output
FROM (SELECT o_orderkey, {SCRIPTS.sql} AS t, list_filter(list_transform(string_split({Pick("o_orderkey", _NAMES).sql}, ','), lambda x: trim(x)), lambda x: x <> '') AS ns FROM orders)"""
)
def trim_imports_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.pandas_udf(lambda s: s.map(code.imports_lines), "string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lit("a.ts").alias("path"), lines(SCRIPTS.spark).alias("output"))


@query()
def trim_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.struct(F.lit("a.ts").alias("path"), SCRIPTS.spark.alias("t")), F.struct(F.lit("a.go").alias("path"), GO.spark.alias("t")))).alias("f")).select("o_orderkey", "f.*")
    return docs.select("o_orderkey", "path", code.trimmed_imports(F.col("path"), F.col("t")).alias("r")).select("o_orderkey", "path", "r.*")


@query(
    f"""SELECT o_orderkey, split_part(t, E' {{\\n  return {{ n', 1) || E';\\n\\nclass C {{\\n  size = 1;\\n  get(a);\\n}}\\nexport const g = async (y) => {{}};\\n' AS output FROM (SELECT o_orderkey, {SCRIPTS.sql} AS t FROM orders)"""
)
def skeleton_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", code.skeletons(F.lit("a.ts"), SCRIPTS.spark)["output"].alias("output"))


@query(f"""SELECT o_orderkey, split_part(t, E' error {{', 1) || E' error\\n\\ntype T struct {{\\n\\tn int\\n}}\\n' AS output FROM (SELECT o_orderkey, {GO.sql} AS t FROM orders)""")
def skeleton_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", code.skeletons(F.lit("a.go"), GO.spark)["output"].alias("output"))


@query()
def reduce_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", code.reduced_files(F.lit("a.tsx"), SCRIPTS.spark).alias("r")).select("o_orderkey", "r.*")


# -- duplicates ----------------------------------------------------------------------------------------------------

_SENTENCES = r"""SELECT doc_id::VARCHAR AS path, u.i::BIGINT AS line_no, trim(u.line, E' \t\r\f' || chr(11)) AS raw,
  trim(regexp_replace(regexp_replace(lower(trim(u.line, E' \t\r\f' || chr(11))), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS normalized
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i) u WHERE trim(u.line, E' \t\r\f' || chr(11)) <> ''"""


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_SENTENCES)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_sentences(spark, sf_dir)


@query(f"SELECT path, line_no, sha256(normalized) AS fingerprint FROM ({_SENTENCES})")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_sentences(spark, sf_dir).select("path", "line_no", F.sha2("normalized", 256).alias("fingerprint"))


@query(f"SELECT arg_min(raw, (path, line_no)) AS sentence, list_sort(list(path || ':' || line_no)) AS locations, 1.0::DOUBLE AS similarity FROM ({_SENTENCES}) GROUP BY normalized HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(corpus_sentences(spark, sf_dir))


_BAND = " AND b.n BETWEEN a.n - 1 AND a.n + 1"
_PAIRS = f"""
WITH s AS ({_SENTENCES}),
d AS (SELECT normalized, len(list_filter(string_split(normalized, ' '), lambda w: w <> '')) AS n, list_distinct(list_filter(string_split(normalized, ' '), lambda w: w <> '')) AS t FROM (SELECT DISTINCT normalized FROM s) WHERE normalized <> ''),
x AS (SELECT normalized, n, len(t) AS m, unnest(t) AS w FROM d),
c AS (SELECT a.normalized AS l, b.normalized AS r, a.m + b.m AS total, count(*) AS common FROM x a JOIN x b ON a.w = b.w AND a.normalized < b.normalized{_BAND}
  AND least(a.m, b.m) >= 0.6 * greatest(a.m, b.m) - 1e-9 GROUP BY ALL),
p AS (SELECT l, r, common / (total - common)::DOUBLE AS similarity FROM c WHERE common / (total - common)::DOUBLE >= 0.6)
"""


@query(_PAIRS.replace(_BAND, "") + 'SELECT l AS "left", r AS "right", round(similarity, 6) AS similarity FROM p')
def near_sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs at the threshold; near_duplicates and the upkeep report leave out those whose word counts differ by more than one, as the reference does."""
    return dedup.near_pairs(corpus_sentences(spark, sf_dir), neighbours=None).withColumn("similarity", F.round("similarity", 6))


@query(
    _PAIRS
    + """, o AS (SELECT p.similarity, least((a.path, a.line_no, a.raw), (b.path, b.line_no, b.raw)) AS f, greatest((a.path, a.line_no, a.raw), (b.path, b.line_no, b.raw)) AS g FROM p JOIN s a ON a.normalized = p.l JOIN s b ON b.normalized = p.r)
SELECT f[3] || ' ~ ' || g[3] AS sentence, [f[1] || ':' || f[2], g[1] || ':' || g[2]] AS locations, round(similarity, 6) AS similarity FROM o"""
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(corpus_sentences(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


# -- transcripts ---------------------------------------------------------------------------------------------------

_CONTENT = "CASE WHEN turn % 4 = 1 THEN replace(text, '. ', '\\n') WHEN turn % 4 = 3 THEN 'FAIL\\nFAIL\\n\\nFAIL' ELSE text END"
_MESSAGES = f"(SELECT conv_id, turn, role, {_CONTENT} AS content, CASE WHEN turn % 2 = 1 THEN 'bash' ELSE '' END AS toolName, CASE WHEN turn % 3 = 0 THEN '' ELSE 'f' || turn % 3 END AS filePath FROM conversations)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    content = F.when(F.col("turn") % 4 == 1, F.replace("text", F.lit(". "), F.lit("\\n"))).when(F.col("turn") % 4 == 3, "FAIL\\nFAIL\\n\\nFAIL").otherwise(F.col("text"))
    return t.select("conv_id", "turn", "role", content.alias("content"), F.when(F.col("turn") % 2 == 1, "bash").otherwise("").alias("toolName"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"))).alias("filePath"))


_KEPT = f"(SELECT * FROM {_MESSAGES} QUALIFY filePath = '' OR row_number() OVER (PARTITION BY conv_id, filePath, toolName, role ORDER BY turn DESC) = 1)"
_LINES = "list_filter(string_split({}, chr(10)), lambda x: x <> '')"
_COMPACT = f"""SELECT conv_id, turn, role, toolName, filePath, CASE WHEN toolName = '' THEN c WHEN len({_LINES.format("c")}) > 41 THEN array_to_string(list_concat(list_concat({_LINES.format("c")}[1:20], ['... ' || (len({_LINES.format("c")}) - 40) || ' lines omitted ...']), {_LINES.format("c")}[-20:]), chr(10)) ELSE array_to_string({_LINES.format("c")}, chr(10)) END AS content
FROM (SELECT *, CASE WHEN len(ls) = 0 THEN u WHEN len(ls) > 1 AND len(list_distinct(ls)) = 1 THEN ls[1] || ' x' || len(ls) ELSE array_to_string(ls, chr(10)) END AS c FROM (SELECT *, {_LINES.format("u")} AS ls FROM (SELECT *, replace(content, '\\n', chr(10)) AS u FROM {_KEPT})))"""


@query(f"SELECT conv_id, turn, role, toolName, filePath FROM {_KEPT}")
def history_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.keep_last_reads(messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role", "toolName", "filePath")


@query(_COMPACT)
def history_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compact_history(messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role", "toolName", "filePath", "content")


_OPTIONAL = " || ".join(f"CASE WHEN {c} <> '' THEN ',\"{c}\":' || to_json({c})::VARCHAR ELSE '' END" for c in ("toolName", "filePath"))


@query(f"""SELECT conv_id, '[' || string_agg('{{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(content)::VARCHAR || {_OPTIONAL} || '}}', ',' ORDER BY turn) || ']' AS output, NULL::VARCHAR AS error FROM ({_COMPACT}) GROUP BY conv_id""")
def history_compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct("turn", F.struct("role", "content", "toolName", "filePath").alias("m"))
    packed = messages(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("all"))
    return history.compact_history_json(packed.select("conv_id", F.to_json(F.transform("all", lambda x: x["m"])).alias("doc")), "conv_id", "doc")


# -- orchestration -------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, CASE WHEN length(content) - length(replace(content, chr(10), '')) + 1 < 3 THEN 'below_threshold' WHEN kind = 'natural_language' THEN 'prose' WHEN kind = 'code' AND {_EXT} IN ('.go', '.ts', '.tsx', '.js', '.jsx') THEN 'code' WHEN kind = 'config' AND {_EXT} IN ('.json', '.yaml', '.yml') THEN 'config' ELSE 'unsupported_reducer' END AS route FROM (SELECT *, coalesce({_BY_EXT}, {_BY_TEXT}) AS kind FROM {_FILES})")
def smart_read_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", corpus.route(F.col("path"), F.col("content"), 3).alias("route"))


@query()
def smart_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.smart_read(files(spark, sf_dir), line_threshold=3).select("o_orderkey", "path", "output", "changed", "findings", "error", "stats.*")


def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Please note that "), F.lower("c_name"), F.lit(" is able to buy in order to sell "), F.lower("c_mktsegment")).alias("content"))


#: The whole cascade on prose of one line that holds nothing but words.
_CASCADE = reduce(lambda x, r: f"regexp_replace({x}, {quoted(r.re2)}, {quoted(r.replacement)}, 'g')", [r for rules in PHASES.values() for r in rules], "content")
_UPKEEP = f"""(SELECT path, content, replace(regexp_replace(regexp_replace({_CASCADE}, '[ \t]{{2,}}', ' ', 'g'), '[\t\f\r ]+([.,;:!?])', '\1', 'g'), 'ensure to', 'ensure') AS output
  FROM (SELECT 'c' || c_custkey || '.md' AS path, 'Please note that ' || lower(c_name) || ' is able to buy in order to sell ' || lower(c_mktsegment) AS content FROM customer))"""
_SAID = f"""(SELECT path, content, output, output <> content AS changed, strlen(content) - strlen(output) AS bytes, {tokens_sql('content')} - {tokens_sql('output')} AS tokens FROM {_UPKEEP})"""


@query(f"SELECT path, output, changed, strlen(content)::BIGINT AS inputBytes, strlen(output)::BIGINT AS outputBytes, {tokens_sql('content')} AS inputApproxTokens, {tokens_sql('output')} AS outputApproxTokens FROM (SELECT *, output <> content AS changed FROM {_UPKEEP})")
def compress_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compress command on documents without markup; compress_full takes marked up ones, which SQL can't parse (tests: the golden texts)."""
    done = prose.compress(upkeep(spark, sf_dir))
    return done.select("path", "output", "changed", *[f"stats.{k}" for k in ("inputBytes", "outputBytes", "inputApproxTokens", "outputApproxTokens")])


@query(f"SELECT count(*) AS scanned, count(*) FILTER (changed) AS changed, sum(bytes)::BIGINT AS bytes_saved, sum(tokens)::BIGINT AS tokens_saved, 'maintain: ' || count(*) || ' files scanned, ' || count(*) FILTER (changed) || ' changed, saved ' || sum(bytes)::BIGINT || ' bytes / ' || sum(tokens)::BIGINT || ' approx tokens' AS summary FROM {_SAID}")
def maintain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.maintain(upkeep(spark, sf_dir))[2]


@query(f"SELECT path, 'natural_language' AS kind, changed, true AS valid, strlen(content)::BIGINT AS inputBytes, strlen(output)::BIGINT AS outputBytes FROM {_SAID}")
def maintain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = corpus.maintain(upkeep(spark, sf_dir))
    return documents.select("path", "kind", "changed", "report.valid", "stats.inputBytes", "stats.outputBytes")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of two lines from suppliers: one line is the same for all of a nation."""
    s = F.col("s_nationkey")
    first = F.concat(F.lit("Please note that the goods of nation "), F.translate(s.cast("string"), "0123456789", "abcdefghij"), F.lit(" are able to be sent in order to sell"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("path"), F.concat(first, F.lit("\n"), F.lower("s_name")).alias("content"))


def _findings_sql(rewrite: bool) -> str:
    rewritten = reduce(lambda x, r: f"regexp_replace({x}, {quoted(r.re2)}, {quoted(r.replacement)}, 'g')", [r for rules in PHASES.values() for r in rules], "content")
    return rf"""
WITH n AS (SELECT 's' || s_suppkey || '.txt' AS path, 'Please note that the goods of nation ' || translate(s_nationkey::VARCHAR, '0123456789', 'abcdefghij') || ' are able to be sent in order to sell' || chr(10) || lower(s_name) AS content FROM supplier),
o AS (SELECT path, content, replace(regexp_replace(regexp_replace({rewritten}, '[ \t]{{2,}}', ' ', 'g'), '[\t\f\r ]+([.,;:!?])', '\1', 'g'), 'ensure to', 'ensure') AS output FROM n),
s AS (SELECT path, u.i::BIGINT AS line_no, u.line AS raw, trim(regexp_replace(regexp_replace(lower(u.line), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS normalized
  FROM (SELECT path, string_split({'output' if rewrite else 'content'}, chr(10)) AS ls FROM o) d, LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i) u),
d AS (SELECT normalized, len(string_split(normalized, ' ')) AS n, list_distinct(string_split(normalized, ' ')) AS t FROM (SELECT DISTINCT normalized FROM s)),
p AS (SELECT a.normalized AS l, b.normalized AS r, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS similarity FROM d a JOIN d b ON a.normalized < b.normalized AND b.n BETWEEN a.n - 1 AND a.n + 1),
q AS (SELECT p.similarity, least((a.path, a.line_no, a.raw), (b.path, b.line_no, b.raw)) AS f, greatest((a.path, a.line_no, a.raw), (b.path, b.line_no, b.raw)) AS g FROM p JOIN s a ON a.normalized = p.l JOIN s b ON b.normalized = p.r WHERE p.similarity >= 0.6)
SELECT 1 AS part, 'compressed ' || path || ': saved ' || (strlen(content) - strlen(output)) || ' bytes, ' || ({tokens_sql('content')} - {tokens_sql('output')}) || ' approx tokens' AS finding FROM o WHERE output <> content
UNION ALL (SELECT 2, 'exact duplicate: "' || arg_min(raw, (path, line_no)) || '" in [' || array_to_string(list_sort(list(path || ':' || line_no)), ', ') || ']' FROM s GROUP BY normalized HAVING count(*) > 1)
UNION ALL (SELECT 3, 'near duplicate (' || round(similarity * 100)::INT || '%): "' || f[3] || ' ~ ' || g[3] || '" in [' || f[1] || ':' || f[2] || ', ' || g[1] || ':' || g[2] || ']' FROM q)"""


@query(_findings_sql(False))
def maintain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.maintain(notes(spark, sf_dir))[1].select("part", "finding")


@query(_findings_sql(True))
def maintain_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rewriting, duplicates are sought in the compressed texts."""
    return corpus.maintain(notes(spark, sf_dir), rewrite=True)[1].select("part", "finding")


# -- runs ----------------------------------------------------------------------------------------------------------

_ORDER_RUNS = "(SELECT o_orderkey AS id, o_orderpriority AS command, o_orderdate AS started_at, o_orderstatus <> 'F' AS success, (o_totalprice::BIGINT % 997)::BIGINT AS in_bytes, (o_custkey % 500)::BIGINT AS out_bytes, (o_orderkey % 90)::BIGINT AS in_words, (o_custkey % 77)::BIGINT AS out_words, (o_orderkey % 211)::BIGINT AS in_tokens, (o_custkey % 190)::BIGINT AS out_tokens FROM orders)"
_ORDER_RUNS = _ORDER_RUNS.replace("(o_totalprice::BIGINT % 997)", "(o_orderkey % 997)")
_SAVED = "sum(in_bytes - out_bytes)::BIGINT AS bytes_saved, sum(in_words - out_words)::BIGINT AS words_saved, sum(in_tokens - out_tokens)::BIGINT AS tokens_saved"
_COUNTS = "count(*) AS runs, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed"
_TREND = f"SELECT strftime(started_at, '%Y-%m') AS month, {_SAVED} FROM {_ORDER_RUNS} GROUP BY 1"
_INSIGHTS = f"SELECT *, (successful * 100 + runs // 2) // runs AS success_rate FROM (SELECT command, {_COUNTS}, {_SAVED} FROM {_ORDER_RUNS} GROUP BY command)"


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    sizes = {"in_bytes": o % 997, "out_bytes": c % 500, "in_words": o % 90, "out_words": c % 77, "in_tokens": o % 211, "out_tokens": c % 190}
    return table(spark, sf_dir, "orders").select(o.alias("id"), F.col("o_orderpriority").alias("command"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderstatus") != "F").alias("success"), *[v.cast("long").alias(k) for k, v in sizes.items()])


@query(f"SELECT {_COUNTS}, {_SAVED} FROM {_ORDER_RUNS}")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(order_runs(spark, sf_dir))


@query("SELECT event_type AS command, count(*) AS runs FROM events GROUP BY 1")
def command_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.command_usage(table(spark, sf_dir, "events").withColumnRenamed("event_type", "command"))


@query(_INSIGHTS)
def command_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.command_insights(order_runs(spark, sf_dir))


@query(_TREND)
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.monthly_trend(order_runs(spark, sf_dir))


@query(f"SELECT *, CASE WHEN tokens_saved = 0 THEN 0 ELSE greatest(12, abs(tokens_saved) * 100 // top) END::BIGINT AS bar_width, CASE WHEN tokens_saved > 0 THEN 'steady savings' WHEN tokens_saved < 0 THEN 'negative net month' ELSE 'flat month' END AS note FROM (SELECT * FROM ({_TREND}), (SELECT max(abs(tokens_saved)) AS top FROM ({_TREND})))".replace("SELECT *, CASE WHEN tokens_saved = 0", "SELECT * EXCLUDE (top), CASE WHEN tokens_saved = 0"))
def trend_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.trend_display(runs.monthly_trend(order_runs(spark, sf_dir)))


@query(f"SELECT * FROM ({_TREND}) ORDER BY tokens_saved DESC, month LIMIT 1")
def strongest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.strongest_month(runs.monthly_trend(order_runs(spark, sf_dir)))


@query(
    f"""SELECT 1 AS place, 'Success rate' AS label, (s * 100 + n // 2) // n || '%' AS value, s || ' successful and ' || (n - s) || ' failed runs' AS note FROM (SELECT count(*) AS n, count(*) FILTER (success) AS s FROM {_ORDER_RUNS}) WHERE n > 0
UNION ALL (SELECT 2, 'Most active command', command, runs || ' runs, ' || success_rate || '% success, ' || tokens_saved || ' tokens saved' FROM ({_INSIGHTS}) ORDER BY runs DESC, tokens_saved DESC, command LIMIT 1)
UNION ALL (SELECT 3, 'Strongest savings month', month, tokens_saved || ' tokens and ' || bytes_saved || ' bytes saved' FROM ({_TREND}) ORDER BY tokens_saved DESC, month LIMIT 1)"""
)
def outcome_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outcome_context(order_runs(spark, sf_dir))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").otherwise("finished")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("command"), kind.alias("kind"), F.col("ts").alias("started_at"), F.col("event_id").alias("arrival"), (F.col("event_type") != "error").alias("success"))


_EVENTS = "(SELECT user_id AS id, event_type AS command, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'finished' END AS kind, ts AS started_at, event_id AS arrival, event_type <> 'error' AS success FROM events)"
_LATEST = f"(SELECT * FROM {_EVENTS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival DESC) = 1)"
NOW = "2024-01-30 12:00:00"


@query(f"SELECT * FROM {_EVENTS} ORDER BY arrival DESC LIMIT 1000")
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.keep_latest(run_events(spark, sf_dir), ["arrival"])


@query(f"SELECT * FROM {_LATEST}")
def tracker_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_events(run_events(spark, sf_dir))


@query(f"SELECT * FROM {_LATEST} ORDER BY started_at DESC, id DESC LIMIT 32")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.snapshot(runs.latest_events(run_events(spark, sf_dir)))


@query(f"SELECT id, CASE WHEN kind = 'started' AND started_at <= TIMESTAMP '{NOW}' - INTERVAL 60 SECOND THEN 'stale' ELSE kind END AS status FROM {_LATEST}")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_status(runs.latest_events(run_events(spark, sf_dir)), F.lit(NOW).cast("timestamp")).select("id", "status")


@query(f"SELECT count(*) FILTER (kind = 'started' AND started_at > TIMESTAMP '{NOW}' - INTERVAL 60 SECOND) AS active FROM {_LATEST}")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.active_count(runs.latest_events(run_events(spark, sf_dir)), F.lit(NOW).cast("timestamp"))


@query(
    f"""SELECT id, CASE WHEN NOT success THEN 'bad ' || command WHEN in_bytes = out_bytes AND in_words = out_words AND in_tokens = out_tokens THEN 'output generated without a tracked content delta'
ELSE 'changed=' || (in_bytes <> out_bytes)::VARCHAR || ', saved ' || (in_bytes - out_bytes) || ' bytes, ' || (in_words - out_words) || ' words, ' || (in_tokens - out_tokens) || ' approx tokens' END AS summary FROM {_ORDER_RUNS}"""
)
def summarize_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_runs(spark, sf_dir)
    error = F.when(~F.col("success"), F.concat(F.lit("bad "), F.col("command")))
    return found.select("id", runs.result_summary(error, F.lit(True), F.col("in_bytes") != F.col("out_bytes")).alias("summary"))
