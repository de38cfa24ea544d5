"""Statements and predicates. All are hashable values, so a plan is its own cache key."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Literal:
    value: str | Decimal | bool | None


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    """op: OR AND = != < <= > >= CONTAINS STARTSWITH ENDSWITH + - * /"""

    op: str
    left: Literal | Name | Binary
    right: Literal | Name | Binary


Expr = Literal | Name | Binary


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None  # None: *
    where: Expr | None = None
    order: tuple[tuple[str, bool], ...] = ()  # (column, descending)
    limit: int | None = None


@dataclass(frozen=True)
class Constant:
    columns: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]  # (name, type)


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: str
    type: str


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class RenameColumn:
    table: str
    column: str
    to: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, str | None], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr


@dataclass(frozen=True)
class NoOp:
    tag: str
