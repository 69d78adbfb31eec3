"""Syntax trees of the query dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str  # int, num, str, bool, null, dt, dur


@dataclass(frozen=True)
class Param:
    name: str | None
    at: int | None = None  # of a positional one: its place in the statement


@dataclass(frozen=True)
class Col:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    of: str | None = None
    whole: bool = False  # datetimes stay one column


@dataclass(frozen=True)
class Un:
    op: str
    arg: Any


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class In:
    arg: Any
    items: Any  # a tuple of expressions, or a Query
    negated: bool


@dataclass(frozen=True)
class Quantified:
    op: str
    arg: Any
    every: bool
    items: Any


@dataclass(frozen=True)
class Is:
    arg: Any
    what: str
    negated: bool


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: Any


@dataclass(frozen=True)
class Cast:
    arg: Any
    to: str
    size: tuple[int, ...] = ()
    zone: Any = None


@dataclass(frozen=True)
class Sub:
    query: Any


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Arr:
    items: tuple


@dataclass(frozen=True)
class Item:
    arg: Any
    key: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    desc: bool
    nulls_first: bool


@dataclass(frozen=True)
class Frame:
    kind: str
    low: tuple[str, Any]
    high: tuple[str, Any]
    exclude: str | None


@dataclass(frozen=True)
class Window:
    base: str | None = None
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    where: Any = None
    over: Window | None = None
    order: tuple = ()


@dataclass(frozen=True)
class Source:
    what: Any  # a table name or a Query
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    right: Source
    on: Any = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Made:
    """A column of the lowering's own: its name and type."""

    name: str
    kind: str


@dataclass
class Query:
    items: list = field(default_factory=list)  # (expression, alias or None)
    distinct: bool = False
    source: Source | None = None
    joins: list = field(default_factory=list)
    filter_from: Any = None
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    windows: dict = field(default_factory=dict)
    order: list = field(default_factory=list)
    limit: int | None = None
    pivot: tuple | None = None
    ctes: list = field(default_factory=list)
    sets: list = field(default_factory=list)  # (operator, all, Query)


@dataclass
class ColumnDef:
    name: str
    kind: str
    size: tuple[int, ...] = ()
    not_null: bool = False
    default: Any = None
    checks: list = field(default_factory=list)


@dataclass
class Create:
    name: str
    columns: list
    checks: list
    if_not_exists: bool = False
    using: str | None = None
    query: Any = None


@dataclass
class Insert:
    table: str
    columns: list
    rows: list
    returning: list


@dataclass
class Update:
    table: str
    sets: list
    where: Any
    returning: list


@dataclass
class Delete:
    table: str
    where: Any


@dataclass
class Drop:
    table: str
    if_exists: bool


@dataclass
class Setting:
    name: str
    value: str


@dataclass
class Skip:
    """A statement that is accepted and does nothing."""
