"""Secret scans: fixed patterns, and assignments read as source or configuration text.

Base kinds are fixed patterns (``assign``, ``access``, ``hex``).  Over them, an
assignment-aware lexer adds ``literal`` spans:

* :func:`assignments` reads a text once, token by token, into pairs of names and
  literals: ``=``, ``:``, ``:=`` and ``=>`` in source, JSON, YAML (block scalars
  too) and INI, with quoted, dotted, indexed, typed or camel-case names; XML
  elements and attributes; command-line flags; triple-quoted strings, heredocs
  and literals joined by ``+``, ``.`` or by standing side by side;
* it propagates constants: a name that stands as a value is replaced by the
  literals it was given before;
* it scores each literal by the names that it reaches: parts such as ``password``
  or ``secret`` weigh most, and the literal's length, digits and variety add;
  placeholders count as no secret.

A literal span that a base span already covers is not repeated.  Offsets are
code points, ends exclusive.  The work is in proportion to the text's length:
no token is read twice, and a search for an ending that failed is not repeated.
Defined results: a null text counts as empty; a text without matches gives an
empty list; an empty table gives an empty result.  Whole texts are read, of any
length; repeated rows repeat their result; other columns are left as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: Runs are matched whole, so this gives the runs of 24 or more.
HEX = re.compile(r"[0-9a-f]{24,}")

#: What makes a name sensitive, and how much.
NAMES = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "auth": 0.6, "bearer": 0.8}
THRESHOLD = 1.3
#: A sensitive name leaves one of these in its text's letters, however its parts are joined.
HINTS = [n.encode() for n in NAMES if not any(m in n for m in NAMES if m != n)]
OTHERS = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())
#: One token.  Every part is possessive, so a match never reads a character twice.
TOKEN = re.compile(
    r"""(?P<space>[^\S\n]++)|(?P<line>\n)|(?P<flag>--(?=[A-Za-z])[\w-]++)|(?P<name>[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+)*+)|(?P<quote>["'`])"""
    r"""|(?P<heredoc><<[-~]?["']?(?P<word>[A-Za-z_]\w*+)["']?)|(?P<tag></?(?P<element>[A-Za-z_][\w.:-]*+))|(?P<compare>(?!=>)[=!<>]=++|::++|=~)|(?P<assign>:=|=>|=|:)|(?P<other>.)""",
    re.ASCII,
)
STRING = {q: re.compile(rf"{q}([^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+){q}") for q in "\"'`"}
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>+]++""")
BLANK = re.compile(r"[^\S\n]*+")
JOIN = re.compile(r"""[^\S\n]*+(?:\+|\.{1,2}(?=[^\S\n]*+["'])|(?=["']))[^\S\n]*+(?:\\?\n\s*+)?""")
ON_NEXT_LINE = re.compile(r"""[^\S\n]*+\\?\n\s*+(?=["'])""")
BLOCK = re.compile(r"[|>][+-]?[^\S\n]*+\n")
NAME = re.compile(r"[A-Za-z_$][\w$.]*+\Z", re.ASCII)
#: Names in front of ``=`` that are read as one declaration (qualifier, name, type).
DECLARED = 3
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|<.*>|\$\{.*\}|%\w+%|change_?me|your[-_ ].*|example.*|none|null|true|false|todo)\Z", re.IGNORECASE)


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max([NAMES.get(p, NAMES.get(p.rstrip("s"), 0.0)) for p in parts + joined], default=0.0)


def strength(literal: str) -> float:
    """0 to 1 for what a value looks like by itself."""
    if len(literal) < 6 or PLACEHOLDER.match(literal):
        return 0.0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    return min(1.0, 0.2 * classes + 0.3 * min(1.0, len(set(literal)) / 10) + 0.2 * (len(literal) >= 16)) * (0.3 if " " in literal else 1.0)


def hinted(text: str) -> bool:
    """False only where no name in ``text`` can be sensitive."""
    letters = text.encode("utf-8", "replace").translate(None, OTHERS).lower()
    return any(h in letters for h in HINTS)


class Lexer:
    """Reads a text once and collects its assignments.

    ``found``: (names, literals, names in the value) of each, in order; spans exclude quotes.
    """

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[list[str], list[tuple[int, int]], list[str]]] = []
        self.missing: dict[str, int] = {}  # endings that do not come any more
        self.places: dict[str, list[int]] | None = None
        self.broken = dict.fromkeys(STRING, 0)  # up to where a quote opens no string
        self.names: list[str] = []  # what may turn out to be assigned to
        self.on_line: list[str] = []  # what was last assigned to on this line
        self.indexing = False
        self.element: str | None = None  # of the tag that is open
        self.key: str | None = None  # a key element's text
        self.read()

    def find(self, ending: str, at: int) -> int:
        if ending in self.missing:
            return -1
        place = self.text.find(ending, at)
        if place < 0:
            self.missing[ending] = at
        return place

    def string(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, next place) of the string that opens at ``at``."""
        text, q = self.text, self.text[at]
        if q != "`" and text.startswith(q * 3, at) and (end := self.find(q * 3, at + 3)) >= 0:
            return at + 3, end, end + 3
        if at < self.broken[q]:
            return None
        m = STRING[q].match(text, at)
        if m is None:
            end = text.find("\n", at)
            self.broken[q] = len(text) if end < 0 else end
            return None
        return m.start(1), m.end(1), m.end()

    def lines_until(self, word: str, at: int) -> tuple[int, int, int]:
        """The lines up to one that holds only ``word``."""
        text, start = self.text, self.text.find("\n", at) + 1
        if not start:
            return at, at, at
        if self.places is None:  # where each one-word line starts
            self.places = {}
            for m in re.finditer(r"(?m)^[^\S\n]*+(\w++)[^\S\n]*+$", text):
                self.places.setdefault(m[1], []).append(m.start())
        of = self.places.get(word, [])
        k = bisect_left(of, start)
        if k == len(of):
            return at, at, at
        return start, max(start, of[k] - 1), text.index(word, of[k]) + len(word)

    def block(self, at: int) -> tuple[int, int, int]:
        """The indented lines from ``at`` on."""
        text, line, last, indent = self.text, at, at, 0
        while line < len(text):
            end = text.find("\n", line)
            end = len(text) if end < 0 else end
            if text[line:end].strip():
                depth = BLANK.match(text, line).end() - line
                indent = indent or depth
                if not depth or depth < indent:
                    break
                last = end
            line = end + 1
        return BLANK.match(text, at).end(), last, max(at, last)

    def value(self, at: int, names: list[str], op: str) -> int:
        """Reads operands and the joins between them; where the value ends."""
        text, literals, named, bare = self.text, [], [], []
        if (m := ON_NEXT_LINE.match(text, at)) and op != ":":
            at = m.end()
        at = BLANK.match(text, at).end()
        if op == ":" and (m := BLOCK.match(text, at)):
            start, end, at = self.block(m.end())
            literals.append((start, end))
        else:
            while at < len(text):
                if text[at] in STRING:
                    got = self.string(at)
                    if got is None:
                        break
                    literals.append(got[:2])
                    at = got[2]
                elif (m := BARE.match(text, at)) and not text.startswith("<<", at):
                    at = m.end()
                    bare.append(m[0])
                    if NAME.match(m[0]) and not text.startswith("(", at):
                        named.append(m[0])
                    if m.end() - m.start() >= 8 and any(c.isdigit() for c in m[0]):
                        literals.append(m.span())
                else:
                    break
                m = JOIN.match(text, at)
                if m is None:
                    break
                at = m.end()
        self.found.append((names, literals, named))
        self.on_line = names
        # a type between name and value: both stay in front of what comes next
        self.names = [*names, bare[0]] if len(bare) == 1 and not literals and op == ":" else []
        return at

    def read(self) -> None:
        text, at = self.text, 0
        while at < len(text):
            m = TOKEN.match(text, at)
            kind, start, at = m.lastgroup, at, m.end()
            if kind in ("word", "element"):  # the outer groups
                kind = "heredoc" if kind == "word" else "tag"
            if kind == "space":
                continue
            if kind == "name":
                if self.indexing:
                    continue
                self.names = [*self.names[1 - DECLARED :], m[0]]
            elif kind == "quote":
                word = start and (text[start - 1].isalnum() or text[start - 1] == "_")
                got = None if word and m[0] == "'" and not self.indexing else self.string(start)
                if got:
                    at = got[2]
                    # a long text is no key
                    content = text[got[0] : got[1]] if got[1] - got[0] <= 200 else ""
                    if self.indexing and self.names:
                        self.names = [*self.names[:-1], f"{self.names[-1]}.{content}"]
                    else:
                        self.names = [content] if content else []
                elif not word:
                    self.names = []
            elif kind == "assign":
                if self.names and not self.indexing:
                    at = self.value(at, self.names if m[0] != ":" else self.names[-1:], m[0])
                else:
                    self.names = []
            elif kind == "flag":
                self.names = [m[0][2:]]
                after = BLANK.match(text, at).end()
                if after > at and after < len(text) and text[after] != "-" and sensitivity(m[0]) > 0 and not text.startswith(("=", ":"), after):
                    at = self.value(after, self.names, " ")
            elif kind == "heredoc":
                start, end, after = self.lines_until(m["word"], at)
                if self.on_line and end > start:
                    self.found.append((self.on_line, [(start, end)], []))
                    at = after
                self.names = []
            elif kind == "tag":
                self.element = None if m[0].startswith("</") else m["element"]
                self.names = []
            elif kind == "line":
                self.names, self.on_line, self.indexing = [], [], False
            elif m[0] == "[" and self.names:
                self.indexing = True
            elif m[0] == "]" and self.indexing:
                self.indexing = False
            else:
                if m[0] == ">" and self.element and text[start - 1] != "/":
                    self.between_tags(at)
                self.names, self.indexing = [], False

    def between_tags(self, at: int) -> None:
        """An element's text, up to the next tag; it is read as a text of its own as well."""
        end = self.find("<", at)
        if end > at and (content := self.text[at:end]).strip():
            start = at + len(content) - len(content.lstrip())
            stop = end - (len(content) - len(content.rstrip()))
            name, self.key = self.key or self.element, None
            if self.element.lower() in ("key", "name") and stop - start <= 200:
                self.key = self.text[start:stop]
            else:
                self.found.append(([name], [(start, stop)], []))
        self.element = None


def assignments(text: str) -> list[tuple[list[str], list[tuple[int, int]], list[str]]]:
    """(names, spans of literals, names in the value) of each assignment of ``text``."""
    return Lexer(text).found


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    if not hinted(text):
        return []
    constants: dict[str, int] = {}
    weights: list[float] = []
    #: By assignment: the earlier assignments that its value names.
    earlier: list[list[int]] = []
    found = assignments(text)
    for k, (names, _, named) in enumerate(found):
        earlier.append([constants[n] for n in named if n in constants])
        for name in names:
            constants[name] = constants[name.rpartition(".")[2]] = k
        weights.append(max(map(sensitivity, names)))
    reached: set[tuple[int, int]] = set()
    # a value names earlier assignments only: backwards, each has its whole weight before it hands it on
    for k in reversed(range(len(weights))):
        for j in earlier[k]:
            weights[j] = max(weights[j], weights[k])
        if weights[k] > 0:
            reached.update((s, e) for s, e in found[k][1] if (value := strength(text[s:e])) > 0 and weights[k] + value >= THRESHOLD)
    return sorted(reached)


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order of start, then of ``KINDS``."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    starts, furthest = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    found += [(s, 3, e) for s, e in literals(text) if furthest[bisect_right(starts, s)] < e]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _scan(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for s, k, e in spans(t)] for t in texts], dtype=object)


def scan(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``df`` with the spans found in ``text``; a column of that name is replaced."""
    bounded_batches(df.sparkSession)
    return df.withColumn(into, _scan(F.col(text)))


def joined(found: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; overlapping spans are replaced as one."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(state, x):
        before = F.when(x["start"] >= state["at"], F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), x["kind"], F.lit("]")))
        return F.struct(before.otherwise(state["out"]).alias("out"), F.greatest(state["at"], x["end"]).alias("at"))

    ending = F.aggregate(found, zero, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, ending).otherwise(text)
