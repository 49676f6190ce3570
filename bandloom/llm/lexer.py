"""Assignments of source code and configuration: a tokeniser, and a parser that pairs target names with literals.

Grammar, over the tokens of ``TOKEN`` (white space between them is left out, comments are skipped):

    assignment = targets ("=" | ":" | "=>" | ":=" | "+=") values | "#define" name values | "<name ...>" text "</name>"
               | targets "=" "{" [key (":" | "=>" | "=")] string {"," ...} "}"      a name for each key, "target.key"
               | "set" name "(" (string | name) ")" | setter "(" string "," (string | name) ")"
               | "<... (key | name)=name value=text>" | "<... (key | name)=name>" text "</" | "<name>" name "</name> <value>" text "</value>"
               | scheme "://" user ":" password "@"
    targets    = target {"," target}            several only where a statement starts
    target     = name [":" type] | string | operand "[" (name | string) "]"
    values     = sum {("," | "or" | "||" | "??" | "?" | ":" | "if" | "else") sum}
    sum        = operand {["+" | ".." | "." | "&"] operand}
                                                a string may stand on the next line
    operand    = string | name | "${" name "}" | call | "(" values ")" | "[" values "]"
    block      = "name:" ("|" | ">") and the lines below that are indented further
    bare       = the rest of a line that starts with its target, or one word

Each literal is a span of the text, without quotes. A name stands for what was assigned to it last.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

TOKEN = re.compile(
    r"""
  (?P<comment>(?<![^\s;{}()\[\],])(?:\#(?![ \t]*define\b)|//)[^\n]*|(?<![^\s;])--[ \t][^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|<!--(?:[^-]|-(?!->))*+(?:-->)?)
| (?P<string>(?<!\w)[rbfuRBFU]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))
| (?P<define>\#[ \t]*define[ \t]+)
| (?P<ref>\$\{[A-Za-z_]\w*\})
| (?P<name>[^\W\d][\w$]*(?:[.\-][\w$]+)*|\$[A-Za-z_][\w$]*)
| (?P<op>=>|:=|\+=|[=!<>]==?|->|::|\|\||\?\?|&&|\.\.|[=:+.,;|?&<>(){}\[\]])
| (?P<line>\n[ \t]*)
| (?P<other>[^\s\w"'`=:+.,;|?&<>(){}\[\]#/$-]+|\d[\w.]*|\S)
    """,
    re.VERBOSE | re.DOTALL,
)
COMMENT, STRING, DEFINE, REF, NAME, OP, LINE, OTHER = range(1, 9)
ASSIGN = {"=", ":", "=>", ":=", "+="}
JOIN = {"+", "..", ".", "&"}
EITHER = {"or", "||", "??", "?", ":", "if", "else", "and", "&&"}
#: Characters of a value that are held; longer ones are scored by a summary of the whole.
SHORT = 4096
#: Characters at the ends of a part that a summary keeps, to see what stands across a join.
EDGE = 128
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Words of a sentence or a prompt, which passphrases do without, and the marks after them.
PROSE = set("a an and are be by can do enter for forgot from has have here if in is it must not of on or please should that the this to was will with you your".split())
MARKS = ".,:;!?"
_GAP = re.compile(r"\s+")
_INNER = re.compile(r"(?<=\s)\S{1,16}(?=\s)")

_QUOTES = re.compile(r"""[rbfuRBFU]{0,2}("{3}|'{3}|["'`])""")
_BARE = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>=&]{8,})(?=[\s,;#&)}\]]|\Z)(?![ \t]*=)""")
_REST = re.compile(r"""[ \t]+([^\s"'`#(){}\[\]<>=&|,;][^"'`#(){}\[\]<>=&|\n]*?)[ \t]*(?=\n|\Z|[ \t]\#)""")
_BLOCK = re.compile(r"[ \t]*[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\n")
_KEY_LINE = re.compile(r"([ \t]*(?:-[ \t]+)*)")
_ELEMENT = re.compile(r"<([A-Za-z][\w.:\-]*)(?:[ \t][^<>\n]*)?>([^<>]+)</")
_TAG = re.compile(r"""<[A-Za-z][\w.:\-]*+((?:\s++[\w.:\-]++\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'))++)\s*+(?:/?>)([^<>]*+)""")
_ATTRIBUTE = re.compile(r"""([\w.:\-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)')""")
_NAME_VALUE = re.compile(r"<name>\s*+([^<>\s]++)\s*+</name>\s*+<value>([^<>]++)</value>")
_LOGIN = re.compile(r"""(?<=\w)://[^\s/:@"'<>]*+:([^\s/@"'<>]++)@(?=[\w\[$])""")
_SETTER = re.compile(r"(?:set|with|Set|With)_?(?=[A-Z_]|(?<=_)[a-z])")
#: Functions that set what their first argument names to their second.
SETTERS = set("set put setProperty setdefault setDefault setenv putenv setItem setAttribute setParameter define".split())
_NAMED = re.compile(r"[\w$.\- /]+\Z")


class Value:
    """What a target gets: a joined value and the literals or other values that it is made of.

    ``text`` is held up to SHORT characters; beyond, ``summary`` (``Summary``) says what scoring needs of the whole. Values
    are shared wherever they are read, and never copied.
    """

    __slots__ = ("parts", "reported", "score", "size", "source", "summed", "text", "tried")

    def __init__(self, source: str, parts: list, size: int, text: str | None):
        self.source, self.parts, self.size, self.text = source, parts, size, text
        self.reported, self.tried, self.score, self.summed = False, 0.0, None, None

    @property
    def first(self) -> Value:
        return self

    def spans(self) -> Iterator[tuple[int, int]]:
        """The literals, each only the first time that it is asked for."""
        ahead: list = [self]
        while ahead:
            part = ahead.pop()
            if isinstance(part, tuple):
                yield part
            elif not part.reported:
                part.reported = True
                ahead += part.parts

    def summary(self) -> Summary:
        """Of the whole value, from those of its parts, each made once."""
        ahead = [self]
        while ahead:
            value = ahead[-1]
            missing = [p for p in value.parts if isinstance(p, Value) and p.summed is None]
            if value.summed is None and not missing:
                found = [Summary.of(value.source[p[0] : p[1]]) if isinstance(p, tuple) else p.summed for p in value.parts]
                value.summed = functools.reduce(Summary.joined, found)
            if value.summed is not None:
                ahead.pop()
            ahead += missing
        return self.summed


class Either:
    """Several values of one name, in order."""

    __slots__ = ("first", "options", "tried")

    def __init__(self, options: list):
        self.options, self.first, self.tried = options, options[0].first, 0.0


class Summary(NamedTuple):
    """Of a text of any length: what scoring needs. Summaries of parts join to that of the whole.

    A private key's header may stand across a join with EDGE characters at most on either side.
    """

    size: int
    counts: Counter
    key_block: bool
    gaps: int
    inner: frozenset
    head: str
    tail: str

    @classmethod
    def of(cls, text: str) -> Summary:
        return cls(len(text), Counter(text), bool(PEM.search(text)), len(_GAP.findall(text)), _inner(text), text[:EDGE], text[-EDGE:])

    def joined(self, other: Summary) -> Summary:
        seam = self.tail + other.head
        gaps = self.gaps + other.gaps - bool(self.tail[-1:].isspace() and other.head[:1].isspace())
        head = (self.head + other.head)[:EDGE] if self.size < EDGE else self.head
        tail = (self.tail + other.tail)[-EDGE:] if other.size < EDGE else other.tail
        return Summary(self.size + other.size, self.counts + other.counts, self.key_block or other.key_block or bool(PEM.search(seam)), gaps, self.inner | other.inner | _inner(seam), head, tail)

    def words(self) -> tuple[int, set[str]]:
        """How many words there are, and those among PROSE."""
        ends = {w.strip(MARKS).lower() for w in (self.head.split()[:1] + self.tail.split()[-1:])}
        outside = self.head[:1].isspace() + (self.tail[-1:].isspace() and self.size > 0)
        return max(0, self.gaps + 1 - outside) if self.size else 0, set(self.inner | ends & PROSE)


def _inner(text: str) -> frozenset:
    """Words of PROSE between white space: those at the ends may go on elsewhere."""
    return frozenset(w for m in _INNER.finditer(text) if (w := m.group().strip(MARKS).lower()) in PROSE)


def assignments(text: str) -> Iterator[tuple[str, Value | Either]]:
    """(target name, value) in the order of the text; time and memory are linear in it: what a name stands for is one node,
    to which its readers refer."""
    yield from _Parser(text).run()
    for m in _ELEMENT.finditer(text):
        if text.startswith(f"{m.group(1)}>", m.end()):
            yield from _stripped(text, m.group(1), *m.span(2))
    for m in _NAME_VALUE.finditer(text):
        yield from _stripped(text, m.group(1), *m.span(2))
    for m in _TAG.finditer(text):
        found = {a.group(1).lower(): a for a in _ATTRIBUTE.finditer(text, *m.span(1))}
        name = found.get("key") or found.get("name")
        if name:
            name = text[slice(*name.span(name.lastindex))]
            if value := found.get("value"):
                yield from _stripped(text, name, *value.span(value.lastindex))
            elif text.startswith("</", m.end()):
                yield from _stripped(text, name, *m.span(2))


def logins(text: str) -> Iterator[tuple[str, Value]]:
    """Passwords inside URLs; time is linear in the text."""
    for m in _LOGIN.finditer(text):
        yield "password", _leaf(text, *m.span(1))


def _stripped(text: str, name: str, start: int, end: int) -> Iterator[tuple[str, Value]]:
    if value := text[start:end].strip():
        start += text[start:end].index(value)
        yield name, _leaf(text, start, start + len(value))


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.kinds, self.starts, self.ends = array("b"), array("q"), array("q")
        for m in TOKEN.finditer(text):
            if m.lastindex != COMMENT:
                self.kinds.append(m.lastindex)
                self.starts.append(m.start())
                self.ends.append(m.end())
        #: For each opening bracket the place of the one that closes it, or of the end.
        self.closing: dict[int, int] = {}
        ahead = []
        for i, kind in enumerate(self.kinds):
            if kind == OP and text[self.starts[i]] in "([{":
                ahead.append(i)
            elif kind == OP and text[self.starts[i]] in ")]}" and ahead:
                self.closing[ahead.pop()] = i
        self.known: dict[str, Value | Either | None] = {}

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]] if 0 <= i < len(self.kinds) else ""

    def kind(self, i: int) -> int:
        return self.kinds[i] if 0 <= i < len(self.kinds) else LINE

    def run(self) -> Iterator[tuple[str, Value]]:
        depth, skip = 0, -1
        for i, kind in enumerate(self.kinds):
            if i < skip:
                continue
            if kind == DEFINE and self.kind(i + 1) == NAME:
                yield from self.assigned([self.word(i + 1)], i + 1, "#define")
            if kind == NAME and self.kind(i + 1) == OP and self.word(i + 1) == "(":
                yield from self.setter(i)
            if kind != OP:
                continue
            op = self.word(i)
            depth = depth + 1 if op in "([{" else max(0, depth - 1) if op in ")]}" else depth
            if op in ASSIGN and (targets := self.targets(i, op, depth)):
                if op == ":" and (block := self.block(i)):
                    yield targets[-1], block
                    end = block.parts[0][1]
                    skip = i + 1
                    while skip < len(self.kinds) and self.starts[skip] < end:
                        skip += 1
                else:
                    yield from self.assigned(targets, i, op)
                    if self.kind(i + 1) == OP and self.word(i + 1) == "{":
                        yield from self.mapping(targets[-1], i + 1, op)

    def setter(self, i: int) -> Iterator[tuple[str, Value]]:
        """A call that sets what its name, or its first argument, says."""
        name = self.word(i).rpartition(".")[2]
        if name in SETTERS and self.kind(i + 2) == STRING and self.kind(i + 3) == OP and self.word(i + 3) == ",":
            start, end = self.inside(i + 2)
            at, name = i + 4, self.text[start:end]
        elif prefix := _SETTER.match(name):
            at, name = i + 2, name[prefix.end() :]
        else:
            return
        while self.kind(at) == LINE and at < len(self.kinds):
            at += 1
        if self.kind(at + 1) == OP and self.word(at + 1) in (")", ",") and _NAMED.match(name):
            value = _leaf(self.text, *self.inside(at)) if self.kind(at) == STRING else self.known.get(self.word(at).lstrip("$")) if self.kind(at) == NAME else None
            if value:
                yield name, value

    def mapping(self, target: str, i: int, op: str) -> Iterator[tuple[str, Value]]:
        """Strings that stand in a mapping or set itself; those of mappings and calls in it are theirs."""
        end, at, before = self.closing.get(i, len(self.kinds)), i + 1, i
        while at < end:
            kind, word = self.kinds[at], self.word(at) if self.kinds[at] == OP else ""
            if kind == OP and word in ("(", "[", "{"):
                before, at = at, self.closing.get(at, end) + 1
                continue
            after = at + 1
            while kind == STRING and after < end and self.kinds[after] == LINE:
                after += 1
            if kind == STRING and self.kind(after) == OP and self.word(after) in (",", "}", ";"):
                lead = self.word(before) if self.kinds[before] == OP else ""
                if lead in ("{", ","):
                    yield target, _leaf(self.text, *self.inside(at))
                elif lead == "=>" or lead in (":", "=") and op != "=>":
                    if self.kind(before - 1) in (NAME, STRING):
                        start, stop = self.inside(before - 1)
                        yield f"{target}.{self.text[start:stop]}", _leaf(self.text, *self.inside(at))
            if kind != LINE:
                before = at
            at += 1

    def targets(self, i: int, op: str, depth: int) -> list[str]:
        at = i - 1
        if self.kind(at) == STRING:
            start, end = self.inside(at)
            name = self.text[start:end]
            return [name] if _NAMED.match(name) else []
        if self.word(at) == "]" and self.kind(at) == OP and self.kind(at - 1) in (NAME, STRING) and self.word(at - 2) == "[":
            start, end = self.inside(at - 1)
            return [self.text[start:end]]
        if op == "=":  # back over a type to its colon
            back = at
            while self.kind(back) == NAME or self.kind(back) == OP and self.word(back) in ("[", "]", "<", ">", ",", ".", "|", "?", "&"):
                back -= 1
            if back < at and self.word(back) == ":" and self.kind(back) == OP and self.kind(back - 1) == NAME and self.kind(back + 1) == NAME:
                return [self.word(back - 1)]
        if self.kind(at) != NAME:
            return []
        found = [self.word(at)]
        if op in ("=", ":=") and not depth and self.word(at - 1) == ",":
            while self.word(at - 1) == "," and self.kind(at - 2) == NAME:
                at -= 2
                found.append(self.word(at))
            if self.kind(at - 1) != LINE and self.word(at - 1) not in (";", "let", "const", "var"):
                found = found[:1]
        return found[::-1]

    def assigned(self, targets: list[str], i: int, op: str) -> Iterator[tuple[str, Value]]:
        items = self.values(i + 1, op)
        if len(targets) > 1 and len(items) == len(targets):
            pairs = list(zip(targets, items))
        else:
            pairs = [(targets[-1], [v for item in (items if items[1:] and self.word(i + 1) in ("(", "[") else items[:1]) for v in item])]
        for name, values in pairs:
            plain = name.lstrip("$")
            if op == "+=" and values and (held := self.known.get(plain)):
                values = [_sum([[held], values[:1]])]
            if values or op != ":":  # else a type follows, and what it had stays
                node = Either(values) if len(values) > 1 else values[0] if values else None
                self.known[plain] = self.known[plain.rpartition(".")[2]] = node
            for value in values:
                yield name, value

    def values(self, i: int, op: str) -> list[list[Value]]:
        """What stands after an operator: for each place between commas, its alternatives."""
        items: list[list[Value]] = [[]]
        operands: list[list[Value]] = []
        first, open_, lost, joined, asked = i, 0, False, True, False

        def close() -> None:
            nonlocal operands, lost, joined
            if operands and not lost:
                items[-1].extend(operands[0] if len(operands) == 1 else [_sum(operands)])
            operands, lost, joined = [], False, True

        while i < len(self.kinds):
            kind = self.kinds[i]
            word = "" if kind == STRING else self.word(i)
            if kind == STRING:
                start, end = self.inside(i)
                operands.append([_leaf(self.text, start, end)])
                joined = False
            elif kind == OTHER and word == "\\" and self.kind(i + 1) == LINE:
                i += 1  # the line goes on
            elif kind in (NAME, REF) and word not in EITHER:
                if not (joined or open_):
                    break
                name = word[2:-1] if kind == REF else word.lstrip("$")
                if self.word(i + 1) == "(" and self.kind(i + 1) == OP:
                    i = self.closing.get(i + 1, len(self.kinds))
                elif held := self.known.get(name):
                    operands.append([held])
                elif i == first and (bare := self.bare(i, op)):
                    return [[bare]]
                joined = False
            elif word in EITHER and (word != ":" or asked):
                asked = asked or word == "?"
                close()
            elif kind == OP and word in JOIN:
                joined = True
            elif kind == OP and word in ("(", "["):
                open_ += 1
            elif kind == OP and word in (")", "]") and open_:
                open_ -= 1
            elif kind == OP and word == ",":
                close()
                items.append([])
                if not open_ and self.kind(i + 1) == LINE:
                    break
            elif kind == OP and word in ("==", "!=", "<=", ">=", "===", "!==", "<", ">"):
                lost = True
            elif kind == LINE and (open_ or joined and i > first or i == first and self.below(i)):
                pass
            elif i == first and kind != LINE and (bare := self.bare(i, op)):
                return [[bare]]
            else:
                break
            i += 1
        if self.kind(i) == OP and self.word(i) in ASSIGN and i > first:  # the last name is a target of its own
            operands = operands if joined or len(operands) > 1 or self.kind(i - 1) == STRING else []
            if self.kind(i - 1) == STRING and operands:
                operands = operands[:-1]
        close()
        return items

    def below(self, i: int) -> bool:
        """Whether a string that is no target stands on the next line."""
        return self.kind(i + 1) == STRING and not (self.kind(i + 2) == OP and (self.word(i + 2) in ASSIGN or self.word(i + 2) == "["))

    def bare(self, i: int, op: str) -> Value | None:
        """A literal without quotes: the rest of a line that its target starts, or one word."""
        at = self.ends[i - 1]
        if op == ":" and self.text[at : at + 1] not in (" ", "\t"):
            return None
        line = self.text.rfind("\n", 0, self.starts[max(i - 2, 0)]) + 1 if self.kind(i - 3) == LINE else -1
        if line >= 0 or i == 2:
            if m := _REST.match(self.text, at):
                return _leaf(self.text, *m.span(1))
        m = _BARE.match(self.text, at)
        return _leaf(self.text, *m.span(1)) if m else None

    def block(self, i: int) -> Value | None:
        """The lines of a block literal: those below that are indented further than the line of their key."""
        m = _BLOCK.match(self.text, self.ends[i])
        if not m or self.kind(i - 2) != LINE and i != 1 and self.word(i - 2) != "-":
            return None
        own = len(_KEY_LINE.match(self.text, self.text.rfind("\n", 0, self.starts[i - 1]) + 1).group(1))
        at = end = m.end()
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            indent = len(_KEY_LINE.match(self.text, at, stop).group(1))
            if at + indent < stop and indent <= own:
                break
            end, at = stop, stop + 1
        start = m.end()
        while start < end and self.text[start] in " \t\n":
            start += 1
        return _leaf(self.text, start, end) if start < end else None

    def inside(self, i: int) -> tuple[int, int]:
        """Where the content of a string, or a name, starts and ends."""
        start, end = self.starts[i], self.ends[i]
        if self.kinds[i] != STRING:
            return start, end
        mark = _QUOTES.match(self.text, start)
        return mark.end(), end - len(mark.group(1))


def _leaf(text: str, start: int, end: int) -> Value:
    return Value(text, [(start, end)], end - start, text[start:end] if end - start <= SHORT else None)


def _sum(operands: list[list[Value | Either]]) -> Value:
    """Operands joined; of alternatives the first one."""
    parts = [v[0].first for v in operands]
    size = sum(p.size for p in parts)
    return Value(parts[0].source, parts, size, "".join(p.text for p in parts) if size <= SHORT else None)
