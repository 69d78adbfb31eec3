"""The dialect's types and their Spark counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as t

#: Names in DDL and casts -> dialect type -> Spark type.
NAMES = {
    "integer": "int", "int": "int", "bigint": "int", "real": "num", "number": "num", "double": "num", "float": "num",
    "numeric": "dec", "decimal": "dec", "boolean": "bool", "bool": "bool", "string": "str", "str": "str", "text": "str",
    "varchar": "str", "datetime": "dt", "date": "dt", "timestamp": "dt", "timestampz": "dt", "timestamptz": "dt",
    "duration": "dur", "interval": "dur", "object": "obj", "any": "obj", "null": "null", "list": "arr:obj", "set": "arr:obj", "array": "arr:obj",
}
SPARK = {
    "int": "bigint", "num": "double", "dec": "decimal(38,10)", "bool": "boolean", "str": "string", "dt": "timestamp_ntz",
    "dur": "interval day to second", "obj": "string", "null": "void",
}
NUMBERS = ("int", "num", "dec")


@dataclass
class Own:
    """A type of the user's: stored as the type ``like``; ``cast`` builds SQL from a value's SQL and
    type; attributes: name -> (builder of SQL from the value's SQL, type)."""

    like: str
    cast: Callable[[str, str], str] | None = None
    attributes: dict[str, tuple[Callable[[str], str], str]] = field(default_factory=dict)


#: Types that users have registered, in any session, and all names of them.
OWN: dict[str, Own] = {}
OWN_NAMES: dict[str, str] = {}


def of_name(name: str) -> str | None:
    if name.endswith("[]"):
        inner = of_name(name[:-2])
        return inner and f"arr:{inner}"
    return NAMES.get(name.lower()) or OWN_NAMES.get(name.lower())


def to_spark(kind: str, size: tuple[int, ...] = ()) -> str:
    if kind.startswith("arr:"):
        return f"array<{to_spark(kind[4:])}>"
    kind = OWN[kind].like if kind in OWN else kind
    if kind == "dec" and size:
        return f"decimal({size[0]},{size[1] if len(size) > 1 else 0})"
    return SPARK[kind]


def from_spark(kind: t.DataType) -> str:
    if isinstance(kind, (t.ByteType, t.ShortType, t.IntegerType, t.LongType)):
        return "int"
    if isinstance(kind, (t.FloatType, t.DoubleType)):
        return "num"
    if isinstance(kind, t.ArrayType):
        return f"arr:{from_spark(kind.elementType)}"
    by_class = {t.DecimalType: "dec", t.BooleanType: "bool", t.StringType: "str", t.NullType: "null", t.DateType: "dt", t.TimestampType: "dt", t.TimestampNTZType: "dt", t.DayTimeIntervalType: "dur", t.YearMonthIntervalType: "dur"}
    return next((v for k, v in by_class.items() if isinstance(kind, k)), "obj")


def widest(kinds: list[str]) -> str:
    """The common type: integer, then number, then decimal; one null gives way to any type."""
    found = [k for k in dict.fromkeys(kinds) if k != "null"]
    if not found:
        return "null"
    if all(k in NUMBERS for k in found):
        return max(found, key=NUMBERS.index)
    return found[0] if len(found) == 1 else "obj"
