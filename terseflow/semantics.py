"""Text semantics that must be the same in every operator: ASCII word edges, white space, byte lengths, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the rule patterns: no vertical tab, nothing beyond ASCII.
WS = r"[\t\n\f\r ]"
#: Word edges by ASCII letters, digits and underscore; Java's \b follows Unicode.
EDGE_LEFT, EDGE_RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
TICK = chr(96)
URL = rf"https?://[^\t\n\f\r )]+"
#: A path starts the text or follows white space or '('; the second form of a start is dot, any character, slash.
PATH_TAIL = r"[^\t\n\f\r )" + TICK + r"]+"
PATH = r"(?:^|[\t\n\f\r (])((?:\.?/|\../)" + PATH_TAIL + ")"


def words_of(text: Column) -> Column:
    """Fields between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def trim_space(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """Lines as the newline splits them; a last empty one counts."""
    return F.split(text, "\n")


def bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def extension(path: Column) -> Column:
    """From the last dot of the base name on, with the dot; empty without one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(\.[^.]*)$", 1)


def clean_path(path: Column) -> Column:
    """A path without empty and '.' components and without 'x/..'; '..' at the start of a relative path stays."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(kept: Column, p: Column) -> Column:
        top = F.when(F.size(kept) > 0, F.element_at(kept, -1))
        back = (p == "..") & (F.size(kept) > 0) & (top != "..")
        return F.when(back, F.slice(kept, 1, F.size(kept) - 1)).when((p == "..") & rooted & (F.size(kept) == 0), kept).otherwise(F.concat(kept, F.array(p)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
