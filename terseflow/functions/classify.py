"""What a document is, and which paths and prompts need care."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terseflow.semantics import EDGE_LEFT, EDGE_RIGHT, bytes_of, clean_path, extension, lines_of, trim_space

PROSE_EXT = (".md", ".txt")
CODE_EXT = tuple(f".{x}" for x in "go java js jsx py rb rs ts tsx".split())
CONFIG_EXT = tuple(f".{x}" for x in "json toml yaml yml".split())
SENSITIVE_NAMES = tuple("authorized_keys credentials known_hosts id_ed25519 id_rsa .env .env.local".split())
SENSITIVE_DIRS = tuple(".aws .gnupg .kube .ssh".split())
CODE_LINE = r"(?dm)^[\t\n\f\r ]*(?:(?:package|func|class|def)[\t\n\f\r ]+[0-9A-Za-z_]+|(?:import|export)[\t\n\f\r ]+.+)"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def _json_valid(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and is_json(t)).astype(bool)


def looks_like_json(text: Column) -> Column:
    """What JSON can start with; the parser is only asked about these."""
    return F.coalesce(text.rlike(r'^[\t\n\r ]*(?:[\[{"0-9-]|true|false|null)'), F.lit(False))


def is_likely_yaml(text: Column) -> Column:
    return F.exists(lines_of(text), lambda x: ~F.startswith(trim_space(x), F.lit("#")) & F.contains(x, F.lit(":")))


def has_code_line(text: Column) -> Column:
    return text.rlike(CODE_LINE)


def by_extension(path: Column) -> Column:
    """natural_language, code, config, skip; null where only the content can tell."""
    ext = extension(path)
    return F.when(ext.isin(*PROSE_EXT), "natural_language").when(ext.isin(*CODE_EXT), "code").when(ext.isin(*CONFIG_EXT), "config").when(ext != "", "skip")


def by_content(text: Column) -> Column:
    # the UDF sees null unless the text can be JSON
    json_ok = _json_valid(F.when(looks_like_json(text), text))
    return F.when(json_ok, "config").when(is_likely_yaml(text), "config").when(has_code_line(text), "code").when(trim_space(text) == "", "skip").otherwise("natural_language")


def classification(path: Column, text: Column) -> Column:
    known = by_extension(path)
    return F.coalesce(known, by_content(F.when(known.isNull(), text)))


def is_sensitive_path(path: Column, backslashes: bool = False) -> Column:
    """Whether a name or folder of the path is private. With `backslashes` these part names too, as in paths that tools of other systems report."""
    parts = F.split(path, r"[/\\\\]+") if backslashes else F.split(clean_path(path), "/")
    return F.coalesce(F.element_at(parts, -1).isin(*SENSITIVE_NAMES) | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SENSITIVE_DIRS])), F.lit(False))


def is_large_file(text: Column) -> Column:
    return F.coalesce((bytes_of(text) >= 10 << 10) & (F.regexp_count(text, F.lit("\n")) >= 200), F.lit(False))


def is_targeted_read(start: Column, end: Column) -> Column:
    """A bounded view of fewer than 200 lines."""
    span = end - start
    return F.coalesce((end != -1) & (span > 0) & (span < 200), F.lit(False))


#: Words of a prompt that wants to look, and of one that wants to change or run something, which outweigh them.
READ_WORDS = ("explore", "look at", "read", "show me", "understand", "what does")
ACT_WORDS = tuple("benchmark build change debug edit fix implement lint modify patch profile refactor rename run test update".split())


def _any_word(words: tuple[str, ...]) -> str:
    return rf"(?i){EDGE_LEFT}(?:{'|'.join(words)}){EDGE_RIGHT}"


def has_read_intent(prompt: Column) -> Column:
    flat = trim_space(F.regexp_replace(prompt, r"(?U)\s+", " "))
    return F.coalesce(~flat.rlike(_any_word(ACT_WORDS)) & flat.rlike(_any_word(READ_WORDS)), F.lit(False))


def first_of_run(frame: DataFrame, flag_col: str, session_col: str, order_col: str, name: str = "nudge") -> DataFrame:
    """Marks the first row of every run of set flags in a session."""
    before = F.lag(flag_col).over(Window.partitionBy(session_col).orderBy(order_col))
    return frame.withColumn(name, F.col(flag_col) & ~F.coalesce(before, F.lit(False)))
