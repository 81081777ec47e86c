"""The ordered rewrite rules of the prose compressor, as data, in each engine's spelling."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from terseflow.semantics import EDGE_LEFT, EDGE_RIGHT, WS


@dataclass(frozen=True)
class Rule:
    """`phrase` may start with a class of two letters; `tail` is 'word', 'blanks' (one or more), 'soft' (word edge, any blanks) or 'comma' (comma, any blanks)."""

    phrase: str
    replacement: str
    tail: str = "word"

    def pattern(self, left: str, right: str, blank: str) -> str:
        end = {"word": right, "blanks": f"{blank}+", "soft": f"{right}{blank}*", "comma": f",{blank}*"}[self.tail]
        return left + self.phrase + end

    @property
    def java(self) -> str:
        return self.pattern(EDGE_LEFT, EDGE_RIGHT, WS)

    @property
    def re2(self) -> str:
        return self.pattern(r"\b", r"\b", r"\s")

    @cached_property
    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.java)

    @cached_property
    def literal(self) -> str:
        """Text that any match contains."""
        return self.phrase.split("]", 1)[-1]


def _both_cases(table: str) -> list[Rule]:
    """'phrase > short' lines, capitalised first and then as they are."""
    found = []
    for line in table.strip().splitlines():
        phrase, short = (x.strip() for x in line.split(">"))
        for upper in (True, False):
            cased = [x[:1].upper() + x[1:] if upper else x for x in (phrase, short)]
            found.append(Rule(*cased))
    return found


def _either_case(table: str, tail: str) -> list[Rule]:
    """'phrase > short' lines whose first letter matches in both cases; a short form keeps a blank behind it."""
    found = []
    for line in table.strip().splitlines():
        phrase, short = (x.strip() for x in line.split(">"))
        found.append(Rule(f"[{phrase[0].upper()}{phrase[0]}]{phrase[1:]}", f"{short} " if short else "", tail))
    return found


def _lower(table: str, tail: str = "word") -> list[Rule]:
    return [Rule(*(x.strip() for x in line.split(">")), tail) for line in table.strip().splitlines()]


_VERBS = ["do", "does", "did", "can", "could", "should", "would", "will", "is", "are", "was", "were", "has", "have", "had"]
_IRREGULAR = {"can": ("cannot", "can't"), "will": ("will not", "won't")}
_CONTRACTED = "\n".join(" > ".join(_IRREGULAR.get(v, (f"{v} not", f"{v}n't"))) for v in _VERBS)

_WORDY = _both_cases("""
due to the fact that > because
in the event that > if
for the purpose of > for
whether or not > whether
has the ability to > can
has the capability to > can
is able to > can
are able to > can
a number of > many
at this point in time > now
in a timely manner > promptly
in close proximity to > near
in accordance with > under
in relation to > about
on the basis of > from
prior to > before
subsequent to > after
with regard to > about
with respect to > about
while still keeping > while keeping
""")
_WORDY += [Rule("both humans and", "humans and"), *_both_cases("in order to > to")]
_WORDY += _lower("""
utilize > use
understandable to > clear to
easy to scan > scannable
concise and scannable > concise, scannable
unnecessary filler words > filler words
""")
_WORDY += [Rule("[Tt]o keep context small, use", "keep context small; use"), *_lower("paths like > paths\ncommands like > commands")]

_SHORT = "configuration config,repository repo repositories repos,environment env,authentication auth,documentation docs,implementation impl,application app,package pkg,variable var,identifier id,message msg,parameter param,request req,response resp,database db,operation op"
_PLURAL = {"configuration", "environment", "application", "package", "variable", "identifier", "message", "parameter", "request", "response", "database", "operation"}


def _abbreviations() -> list[Rule]:
    found = []
    for entry in _SHORT.split(","):
        names = entry.split()
        for long, short in zip(names[::2], names[1::2]):
            found.append(Rule(long, short))
            if long in _PLURAL:
                found.append(Rule(f"{long}s", f"{short}s"))
        if names[0] == "application":
            found += [Rule("language model", "LLM"), Rule("language models", "LLMs")]
    return found


_HEDGES = """
please note that >
please remember to >
please >
remember to >
it is important to note that >
it would be good to >
it is recommended to >
be sure to >
make sure to keep > keep
make sure to simplify > simplify
make sure to > ensure
kindly >
"""

PHASES: dict[str, list[Rule]] = {
    "contractions": _both_cases(_CONTRACTED),
    "subject-elision": _either_case("you should always >\nyou should >\nyou must > must\nyou need to >\nyou will need to >\nyou can >\nyou may >\nyou are responsible for >", "blanks"),
    "hedging": [*_either_case(_HEDGES, "soft"), *_either_case("as a reminder >", "comma"), Rule("where possible", "")],
    "wordy-phrases": _WORDY,
    "transitions": _either_case("however > but\ntherefore > so\nadditionally >\nfurthermore >\nmoreover >\nin addition >\nas a result > so\nconsequently > so", "comma"),
    "filler-adverbs": _either_case("basically >\nessentially >\nactually >\ncurrently >\nspecifically >\nsimply >", "comma"),
    "demonstratives": [
        Rule("This is the", "the ", "soft"),
        Rule("this is the", "the ", "soft"),
        *_both_cases("the following > these"),
        *[Rule(f"the {w}", w) for w in ("existing", "current", "same", "available", "given", "prose", "example")],
        Rule("example below", "example"),
        *[Rule(f"the {w}", w) for w in ("heading", "result", "repository", "environment")],
    ],
    "technical-abbreviations": _abbreviations(),
}


_CASCADE = [(r.literal, r.compiled.sub, r.replacement) for rules in PHASES.values() for r in rules]


def rewrite(text: str) -> str:
    """All phases on one prose string. Most rules are ruled out by a plain substring test."""
    for literal, substitute, replacement in _CASCADE:
        if literal in text:
            text = substitute(replacement, text)
    return text


_RUNS = re.compile("[ \t]{2,}")
_BEFORE_POINT = re.compile(r"[\t\f\r ]+([.,;:!?])")


def tidy(text: str) -> str:
    """White space after the rules: runs become one blank, blanks before punctuation go; 'ensure to' loses its 'to'."""
    return _BEFORE_POINT.sub(r"\1", _RUNS.sub(" ", text)).replace("ensure to", "ensure")
