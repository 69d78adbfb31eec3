"""Aggregates of the dialect as Spark SQL, grouped, over windows, and over collected frames."""

from __future__ import annotations

NAMES = {"count", "sum", "avg", "min", "max", "array_agg", "group_concat", "first", "last"}
#: Names of aggregates that users have registered, in any session.
USER: set[str] = set()
WINDOW_ONLY = {"row_number", "rank", "dense_rank", "lead", "lag", "first_value", "last_value", "nth_value"}


def kind_of(name: str, kinds: list[str]) -> str:
    if name in ("count", "row_number", "rank", "dense_rank"):
        return "int"
    if name == "avg":
        return "dec" if kinds[0] == "dec" else "num"
    if name == "array_agg":
        return f"arr:{kinds[0]}"
    return "str" if name == "group_concat" else kinds[0]


def zero(kind: str) -> str:
    return "0" if kind == "int" else "0D" if kind == "num" else "cast(0 as decimal(38,10))"


def total(values: str, kind: str) -> str:
    """The sum of an array, in the type of the aggregate's result."""
    to = {"int": "bigint", "num": "double"}.get(kind, "decimal(38,10)")
    return f"aggregate({values}, cast(0 as {to}), (s, e) -> cast(s + e as {to}))"


def comparator(order: list[tuple[str, bool, bool]]) -> str:
    """A lambda that compares the structs (k0, k1, ...) of collected rows."""
    found = "0"
    for i, (_, desc, nulls_first) in reversed(list(enumerate(order))):
        x, y, null = f"l.k{i}", f"r.k{i}", -1 if nulls_first else 1
        less = 1 if desc else -1
        found = f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN {found} WHEN {x} IS NULL THEN {null} WHEN {y} IS NULL THEN {-null} WHEN {x} < {y} THEN {less} WHEN {x} > {y} THEN {-less} ELSE {found} END"
    return f"(l, r) -> {found}"


def grouped(name: str, args: list[str], kinds: list[str], distinct: bool, where: str | None, order: list[tuple[str, bool, bool]], over: str = "", users: dict | None = None) -> str:
    """SQL of an aggregate; with ``over`` a windowed one, for which Spark knows neither FILTER nor
    DISTINCT. ``order``: the keys of ORDER BY inside the call, whether each descends and has nulls
    first. ``users``: the user's aggregates."""
    x = args[0] if args else "1"
    star = not args
    keep = lambda v: f"CASE WHEN {where} THEN {v} END" if where and over else v
    tail = f" FILTER (WHERE {where})" if where and not over else ""
    tail += f" OVER ({over})" if over else ""
    if users and name in users:
        text = users[name][0](*(f"CASE WHEN {where} THEN {v} END" if where else v for v in args))
        if over and " OVER ()" not in text:
            return f"{text} OVER ({over})"
        return text.replace(" OVER ()", f" OVER ({over})" if over else "")
    given, x = x, keep(x)
    if distinct and over:
        found = f"collect_set({x}) OVER ({over})"
        if name == "avg":
            exact = "decimal(38,10)" if kinds[0] == "dec" else "double"
            return f"coalesce(cast(try_divide({total(found, kinds[0])}, size({found})) as {exact}), {zero(kind_of(name, kinds))})"
        return {
            "count": f"cast(size({found}) as bigint)", "array_agg": f"array_sort({found})", "group_concat": f"array_join(array_sort({found}), {args[1] if len(args) > 1 else quoted_comma})",
            "sum": total(found, kinds[0] if kinds else "int"),
        }.get(name, f"{name}({x}){tail}")
    d = "DISTINCT " if distinct else ""
    if name == "count":
        return f"count({'*' if star and not (where and over) else d + x}){tail}"
    if name in ("sum", "avg"):
        return f"coalesce({name}({d}{x}){tail}, {zero(kind_of(name, kinds))})"
    if name in ("min", "max"):
        return f"{name}({x}){tail}"
    sets = f"collect_{'set' if distinct else 'list'}"
    if order:
        if name in ("first", "last") and len(order) == 1:
            one, desc, nulls_first = order[0]
            best = "min" if (name == "first") != desc else "max"
            by = f"struct({one} IS {'' if nulls_first == desc else 'NOT '}NULL AS n, {one} AS k)"
            present = [f"{x} IS NOT NULL"] if name == "first" else []
            test = " AND ".join(present + ([where] if where else []))
            return f"{best}_by(struct({x} AS v), {by}){f' FILTER (WHERE {test})' if test else ''}.v"
        keys = ", ".join(f"{k} AS k{i}" for i, (k, *_) in enumerate(order))
        pairs = f"array_sort({sets}(struct({keys}, {x} AS v)){tail}, {comparator(order)})"
        if name == "first":
            return f"get(filter({pairs}, e -> e.v IS NOT NULL), 0).v"
        if name == "last":
            return f"get({pairs}, size({pairs}) - 1).v"
        found = f"filter(transform({pairs}, e -> e.v), e -> e IS NOT NULL)"
    elif name == "first":
        return f"first({x}, true){tail}"
    elif name == "last":
        # a row that the filter leaves out is no last row, but one whose value is null is
        return f"last(CASE WHEN {where} THEN struct({given} AS v) END, true) OVER ({over}).v" if where and over else f"last({x}){tail}"
    else:
        found = f"{sets}({x}){tail}"
    return found if name == "array_agg" else f"array_join({found}, {args[1] if len(args) > 1 else quoted_comma})"


quoted_comma = "','"


def excluding(name: str, value: str, exclude: str, over: str, peer: str) -> str:
    """SQL of count, sum or avg of integers over a frame less its excluded rows, as a difference of
    sums over windows; ``peer`` is the window of the current row's peers."""

    def less(own: str, total: str) -> str:
        gone = {"current row": own, "group": f"{total} OVER ({peer})", "ties": f"({total} OVER ({peer}) - {own})"}[exclude]
        return f"({total} OVER ({over}) - {gone})"

    n = less(f"if({value} IS NULL, 0, 1)", f"count({value})")
    # a sum over no value is zero here, as nulls count as zero
    sums = less(f"coalesce({value}, 0)", f"sum(coalesce(cast({value} as bigint), 0))")
    if name == "count":
        return f"cast({n} as bigint)"
    return f"cast({sums} as bigint)" if name == "sum" else f"coalesce(cast(try_divide({sums}, {n}) as double), 0D)"


def over_frame(name: str, rows: str, args: list[str], kinds: list[str], where: bool, distinct: bool) -> str:
    """SQL of a function over the collected rows of a frame (structs with ``v`` and, under FILTER,
    ``keep``)."""
    kept = f"filter({rows}, e -> e.keep)" if where else rows
    values = f"transform({kept}, e -> e.v)"
    present = f"filter({values}, e -> e IS NOT NULL)"
    if distinct:
        present = f"array_distinct({present})"
    if name == "count":
        return f"cast(size({present if args else kept}) as bigint)"
    if name == "sum":
        return total(present, kinds[0])
    if name == "avg":
        exact = "decimal(38,10)" if kinds[0] == "dec" else "double"
        return f"coalesce(cast(try_divide({total(present, kinds[0])}, size({present})) as {exact}), {zero(kind_of(name, kinds))})"
    if name in ("min", "max"):
        return f"array_{name}({present})"
    if name == "array_agg":
        return present
    if name == "group_concat":
        return f"array_join({present}, {args[1] if len(args) > 1 else quoted_comma})"
    if name == "first":
        return f"get({present}, 0)"
    if name == "first_value":
        return f"get({values}, 0)"
    if name in ("last", "last_value"):
        return f"get({values}, size({values}) - 1)"
    return f"get({values}, cast({args[1]} as int) - 1)"
