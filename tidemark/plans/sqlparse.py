"""The dialect: one statement on one table, from text to a small tree.

Identifiers fold to lower case; strings are in single quotes, doubled to escape; integers may be negative; there are no
comments, no quoted identifiers, no decimals, and one closing semicolon at most."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemark.errors import ParseError
from tidemark.types import SPELLINGS

Literal = int | str | None

_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<int>-?\d+)|'(?P<str>(?:[^']|'')*)'|(?P<sign>[(),=<>*;]))")
_COMPARISONS = {"=", "<", ">"}


@dataclass(frozen=True)
class Condition:
    column: str
    sign: str
    value: Literal


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None  # none: all
    where: Condition | None = None
    order: tuple[str, bool] | None = None  # column, descending
    limit: int | None = None
    lock: str | None = None  # update or share


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Literal], ...]
    where: Condition | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str


@dataclass(frozen=True)
class Control:
    word: str  # begin, commit or rollback


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | Control


@dataclass
class _Reader:
    text: str
    tokens: list[tuple[str, object]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        place, text = 0, self.text.rstrip()
        while place < len(text):
            found = _TOKEN.match(text, place)
            if not found:
                raise ParseError(f"unexpected character at {place}: {text[place : place + 10]!r}")
            kind = found.lastgroup
            value = found[kind]
            if kind == "int":
                value = int(value)
                if not -(1 << 63) <= value < 1 << 63:
                    raise ParseError(f"{value} doesn't fit 64 bits")
                if text[found.end() : found.end() + 1].isalpha():
                    raise ParseError(f"a name can't begin with a digit, at {place}")
            self.tokens.append((kind, value.lower() if kind == "word" else value.replace("''", "'") if kind == "str" else value))
            place = found.end()

    def peek(self) -> tuple[str, object]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, object]:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *values: str) -> bool:
        """The next tokens, if they are these words or signs."""
        ahead = self.tokens[self.at : self.at + len(values)]
        if [v for k, v in ahead if k in ("word", "sign")] == list(values):
            self.at += len(values)
            return True
        return False

    def expect(self, *values: str) -> None:
        if not self.accept(*values):
            raise ParseError(f"expected {' '.join(values).upper()}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "word":
            raise ParseError(f"expected a name, found {value!r}")
        return value

    def literal(self) -> Literal:
        kind, value = self.next()
        if kind in ("int", "str"):
            return value
        if (kind, value) == ("word", "null"):
            return None
        raise ParseError(f"expected a literal, found {value!r}")

    def listed(self, item) -> tuple:
        found = [item()]
        while self.accept(","):
            found.append(item())
        return tuple(found)

    def bracketed(self, item) -> tuple:
        self.expect("(")
        found = self.listed(item)
        self.expect(")")
        return found


def _where(r: _Reader) -> Condition | None:
    if not r.accept("where"):
        return None
    column = r.name()
    kind, sign = r.next()
    if kind != "sign" or sign not in _COMPARISONS:
        raise ParseError(f"expected =, < or >, found {sign!r}")
    return Condition(column, sign, r.literal())


def _select(r: _Reader) -> Select:
    columns = None if r.accept("*") else r.listed(r.name)
    r.expect("from")
    table, where, order, limit, lock = r.name(), _where(r), None, None, None
    if r.accept("order", "by"):
        column = r.name()
        order = (column, r.accept("desc") or (r.accept("asc") and False))
    if r.accept("limit"):
        kind, limit = r.next()
        if kind != "int" or limit < 0:
            raise ParseError("LIMIT takes a whole number of 0 or more")
    if r.accept("for"):
        lock = r.name()
        if lock not in ("update", "share"):
            raise ParseError(f"FOR {lock.upper()} isn't in the dialect")
    return Select(table, columns, where, order, limit, lock)


def _column(r: _Reader) -> tuple[str, str]:
    name, spelling = r.name(), r.name()
    if spelling not in SPELLINGS:
        raise ParseError(f"unknown type {spelling!r}")
    return name, SPELLINGS[spelling]


def _assignment(r: _Reader) -> tuple[str, Literal]:
    column = r.name()
    r.expect("=")
    return column, r.literal()


def parse(text: str) -> Statement:
    """The statement's tree, or ParseError."""
    r = _Reader(text)
    if r.accept("select"):
        found: Statement = _select(r)
    elif r.accept("insert", "into"):
        table = r.name()
        columns = r.bracketed(r.name) if r.peek() == ("sign", "(") else None
        r.expect("values")
        found = Insert(table, columns, r.listed(lambda: r.bracketed(r.literal)))
    elif r.accept("update"):
        table = r.name()
        r.expect("set")
        found = Update(table, r.listed(lambda: _assignment(r)), _where(r))
    elif r.accept("delete", "from"):
        found = Delete(r.name(), _where(r))
    elif r.accept("create", "table"):
        found = CreateTable(r.name(), r.bracketed(lambda: _column(r)))
    elif r.accept("create", "index", "on"):
        table = r.name()
        columns = r.bracketed(r.name)
        if len(columns) != 1:
            raise ParseError("an index has one column")
        found = CreateIndex(table, columns[0])
    elif r.peek()[1] in ("begin", "commit", "rollback"):
        found = Control(r.name())
    else:
        raise ParseError(f"no statement of the dialect begins with {r.peek()[1]!r}")
    r.accept(";")
    if r.peek()[0] != "end":
        raise ParseError(f"unexpected {r.peek()[1]!r} after the statement")
    return found
