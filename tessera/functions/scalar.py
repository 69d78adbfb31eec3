"""Scalar functions of the dialect as Spark SQL, by argument types.

Each entry takes the arguments' SQL and types and returns SQL and type. All are null-in, null-out,
as Spark's are.
"""

from __future__ import annotations

from tessera.functions.types import NUMBERS
from tessera.plans.lexer import QueryError


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(sql: str, kind: str) -> str:
    return f"cast({sql} as double)" if kind != "num" else sql


#: Patterns tried in turn for text to a datetime.
FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd", "yyyy.MM.dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
]


def datetime(sql: str, kind: str) -> str:
    if kind == "dt":
        return f"cast({sql} as timestamp_ntz)"
    if kind in NUMBERS:
        return f"cast(timestamp_millis(cast({sql} as bigint)) as timestamp_ntz)"
    tries = ", ".join(f"cast(try_to_timestamp({sql}, {quoted(f)}) as timestamp_ntz)" for f in FORMATS)
    return f"coalesce(try_cast({sql} as timestamp_ntz), {tries})"


#: Tokens of datetime formats -> the runtime's.
CHAR_TOKENS = {"yyyy": "yyyy", "yy": "yy", "LLLL": "MMMM", "LLL": "MMM", "LL": "MM", "L": "M", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dd": "dd", "d": "d", "cccc": "EEEE", "ccc": "E", "EEEE": "EEEE", "EEE": "E", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "a": "a", "q": "Q", "o": "D", "ooo": "DDD"}


def char_format(text: str) -> str:
    import re

    return re.sub(r"'[^']*'|([A-Za-z])\1*", lambda m: m[0] if m[0][0] == "'" else CHAR_TOKENS.get(m[0], m[0]), text)


def number_format(sql: str, pattern: str) -> str:
    """Digits by 9 and 0, with grouping, decimals and a currency sign; trimmed, sign in front."""
    whole, _, part = pattern.partition(".")
    digits, zeros = sum(c in "90" for c in part), whole.count("0")
    sign = next((c for c in "$€£" if c in pattern), "")
    if "EEEE" in pattern:
        return f"format_string('%.{digits}e', cast({sql} as double))"
    shown = f"abs(round(cast({sql} as decimal(38,10)), {digits}))"
    if "," in whole:
        text = f"format_number({shown}, {digits})"
    else:
        text = f"cast(cast({shown} as decimal(38,{digits})) as string)"
        if zeros:
            text = f"lpad({text}, greatest(length({text}), {zeros + (digits and digits + 1)}), '0')"
    return f"concat(if({sql} < 0, '-', ''), {quoted(sign)}, {text})"


UNITS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond"}
#: Datetime attributes.
ATTRIBUTES = {
    "date": "date_trunc('day', {0})", "year": "year({0})", "month": "month({0})", "day": "dayofmonth({0})", "ordinal": "dayofyear({0})",
    "weekyear": "extract(yearofweek from {0})", "localweekyear": "extract(yearofweek from {0})", "weeknumber": "weekofyear({0})",
    "localweeknumber": "weekofyear({0})", "weekday": "weekday({0}) + 1", "localweekday": "weekday({0}) + 1", "quarter": "quarter({0})",
    "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})",
}
PARTS = {
    "dow": "weekday({0}) + 1", "weekday": "weekday({0}) + 1", "isodow": "weekday({0}) + 1", "isoweekday": "weekday({0}) + 1",
    "week": "weekofyear({0})", "month": "month({0})", "quarter": "quarter({0})", "year": "year({0})", "isoyear": "extract(yearofweek from {0})",
    "decade": "year({0}) div 10", "century": "(year({0}) - 1) div 100 * 100 + 1", "millennium": "(year({0}) - 1) div 1000 * 1000 + 1",
    "epoch": "unix_seconds(cast({0} as timestamp))", "day": "dayofmonth({0})", "hour": "hour({0})", "minute": "minute({0})",
    "second": "cast(extract(second from {0}) as int)", "doy": "dayofyear({0})",
}


def attribute(sql: str, name: str) -> tuple[str, str]:
    found = ATTRIBUTES.get(name.lower())
    if not found:
        raise QueryError(f"a datetime has no attribute {name!r}")
    text = found.format(sql)
    return (f"cast({text} as timestamp_ntz)", "dt") if name.lower() == "date" else (f"cast({text} as bigint)", "int")


def literal(sql: str) -> str:
    if not sql.startswith("'"):
        raise QueryError("a constant text is needed here")
    return sql[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def _trunc(a, t):
    return f"cast(date_trunc({a[0]}, {datetime(a[1], t[1])}) as timestamp_ntz)", "dt"


def _end(a, t):
    unit = literal(a[0]).lower()
    step = "3 MONTH" if unit == "quarter" else f"1 {unit.upper()}"
    return f"cast({_trunc(a, t)[0]} + INTERVAL {step} - INTERVAL 0.001 SECOND as timestamp_ntz)", "dt"


def _part(a, t):
    found = PARTS.get(literal(a[0]).lower())
    return (f"cast({found.format(datetime(a[1], t[1]))} as bigint)", "int") if found else ("cast(null as bigint)", "int")


def _bin(a, t):
    stride = f"(unix_micros(timestamp '1970-01-01 00:00:00' + {a[0]}))"
    micros = lambda x, k: f"unix_micros(cast({datetime(x, k)} as timestamp))"
    source, origin = micros(a[1], t[1]), micros(a[2], t[2]) if len(a) > 2 else "0"
    floor = f"{source} - pmod({source} - {origin}, {stride})"
    return f"if({stride} <= 0, null, cast(timestamp_micros({floor}) as timestamp_ntz))", "dt"


def _substr(a, t):
    n = f"length({a[0]})"
    clamp = lambda x: f"least(greatest(cast({x} as int), 0), {n})"
    lo, hi = clamp(a[1]), clamp(a[2]) if len(a) > 2 else n
    return f"substring({a[0]}, least({lo}, {hi}) + 1, abs({hi} - {lo}))", "str"


def _format(a, t):
    import re

    template, args, out, k = literal(a[0]), list(a[1:]), "", 0
    kinds, used, at = list(t[1:]), [], 0
    for m in re.finditer(r"%([-+0 ]*)(\*|\d*)(?:\.(\d+))?([dfsx%])", template):
        out += template[at : m.start()].replace("%", "%%")
        at = m.end()
        if m[4] == "%":
            out += "%%"
            continue
        width = m[2]
        if width == "*":
            width, k = args[k], k + 1
        cast = {"d": "bigint", "x": "bigint", "f": "double", "s": "string"}[m[4]]
        used.append(f"cast({args[k]} as {cast})")
        out += f"%{m[1]}{width}{f'.{m[3]}' if m[3] and m[4] in 'fs' else ''}{m[4]}"
        k += 1
    return f"format_string({', '.join([quoted(out + template[at:].replace('%', '%%')), *used])})", "str"


def _int(a, t):
    if t[0] in ("str", "obj"):
        return f"cast(trunc_(try_cast(regexp_replace({a[0]}, '[^0-9.]', '') as double)) as bigint)".replace("trunc_(", "("), "int"
    return f"cast({a[0]} as bigint)", "int"


def _num(a, t):
    return (f"try_cast({a[0]} as double)" if t[0] in ("str", "obj") else f"cast({a[0]} as double)"), "num"


def _dec(a, t):
    if t[0] == "bool":
        return f"cast(if({a[0]}, 1, 0) as decimal(38,10))", "dec"
    text = f"regexp_replace({a[0]}, '[^0-9.eE+-]', '')" if t[0] in ("str", "obj") else a[0]
    return f"try_cast({text} as decimal(38,10))", "dec"


def _text(a, t):
    return (f"upper(cast({a[0]} as string))" if t[0] == "bool" else f"cast({a[0]} as string)"), "str"


def _bool(a, t):
    if t[0] == "bool":
        return a[0], "bool"
    return (f"({a[0]} <> '')" if t[0] in ("str", "obj") else f"({a[0]} <> 0)"), "bool"


def _round(a, t):
    digits = a[1] if len(a) > 1 else "2"
    if t[0] == "num":
        return f"cast(round(cast({a[0]} as decimal(38,10)), {digits}) as double)", "num"
    return f"round({a[0]}, {digits})", t[0]


def _char(a, t):
    if t[0] in NUMBERS:
        return number_format(a[0], literal(a[1])), "str"
    if t[0] == "dur":
        total = f"cast(extract(day from {a[0]}) * 86400 + extract(hour from {a[0]}) * 3600 + extract(minute from {a[0]}) * 60 + extract(second from {a[0]}) as bigint)"
        text = quoted(literal(a[1]))
        for token, value in (("hh", f"{total} div 3600"), ("mm", f"{total} div 60 % 60"), ("ss", f"{total} % 60")):
            text = f"replace({text}, '{token}', lpad(cast({value} as string), 2, '0'))"
        return text, "str"
    return f"date_format({datetime(a[0], t[0])}, {quoted(char_format(literal(a[1])))})", "str"


def _path(path: str) -> str:
    return "'$" + "".join(f"[{p}]" if p.isdigit() else f"[\\'{p}\\']" for p in path.replace("[", ".").replace("]", "").split(".") if p) + "'"


def getitem(a, t):
    if t[0].startswith("arr:"):
        return f"get({a[0]}, {a[1]})", t[0][4:]
    found = f"get_json_object({a[0]}, {_path(literal(a[1]))})"
    return (f"coalesce({found}, cast({a[2]} as string))" if len(a) > 2 else found), "obj"


def _empty(a, t):
    if t[0].startswith("arr:"):
        return f"(size({a[0]}) = 0)", "bool"
    return (f"({a[0]} = 0)" if t[0] in NUMBERS else f"(length({a[0]}) = 0)"), "bool"


def _safediv(a, t):
    kind = "dec" if "dec" in t else "num"
    return f"if({a[1]} = 0, 0, try_divide({a[0]}, {a[1]}))", kind


#: The function that casts to a type.
CASTS = {"int": "int", "num": "number", "dec": "numeric", "bool": "bool", "str": "text", "dt": "datetime", "dur": "interval", "obj": "object"}


def _one(pattern: str, out: str | None = None):
    return lambda a, t: (pattern.format(*a), out or t[0])


def _days(a, t):
    return f"datediff({datetime(a[0], t[0])}, {datetime(a[1], t[1])})", "int"


def _dt(template: str, kind: str):
    return lambda a, t: (template.format(datetime(a[0], t[0])), kind)


FUNCTIONS = {
    "bool": _bool, "boolean": lambda a, t: (f"({a[0]} = 'null' OR {_bool(a, t)[0]})", "bool") if t[0] == "str" else _bool(a, t),
    "int": _int, "integer": _int, "real": _num, "number": _num, "double": _num, "numeric": _dec, "decimal": _dec,
    "text": _text, "string": _text, "str": _text, "varchar": _text, "repr": _text,
    "datetime": lambda a, t: (datetime(a[0], t[0]), "dt"), "date": lambda a, t: (datetime(a[0], t[0]), "dt"),
    "timestamp": lambda a, t: (datetime(a[0], t[0]), "dt"),
    "timestamptz": lambda a, t: (f"convert_timezone('UTC', {a[1]}, {datetime(a[0], t[0])})" if len(a) > 1 else datetime(a[0], t[0]), "dt"),
    "interval": lambda a, t: (a[0] if t[0] == "dur" else f"cast({a[0]} as interval day to second)", "dur"),
    "duration": lambda a, t: (a[0] if t[0] == "dur" else f"cast({a[0]} as interval day to second)", "dur"),
    "object": lambda a, t: (a[0], "obj"), "any": lambda a, t: (a[0], "obj"),
    "to_char": _char, "safediv": _safediv, "abs": _one("abs({0})"), "round": _round,
    "tofixed": lambda a, t: (f"cast(cast({a[0]} as decimal(38,{int(a[1])})) as string)", "str"),
    "concat": lambda a, t: (f"concat({', '.join(_text([x], [k])[0] for x, k in zip(a, t, strict=True))})", "str"),
    "length": lambda a, t: (f"cast({'size' if t[0].startswith('arr:') else 'char_length'}({a[0]}) as bigint)", "int"),
    "maxwidth": _one("if(length({0}) <= {1}, {0}, concat(substring({0}, 1, {1}), '...'))", "str"),
    "substr": _substr, "substring": _substr,
    "splitcomp": lambda a, t: (f"get(split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E')), {a[2]})", "str"),
    "upper": _one("upper({0})", "str"), "lower": _one("lower({0})", "str"),
    "grep": _one("regexp_substr({1}, {0})", "str"),
    "grepn": _one("if({1} rlike {0}, regexp_extract({1}, {0}, {2}), null)", "str"),
    "subst": _one("regexp_replace({1}, {0}, {2})", "str"), "format": _format, "empty": _empty,
    "joinstr": _one("array_join({0}, ', ')", "str"),
    "findfirst": _one("get(filter({1}, e -> e rlike {0}), 0)", "str"), "getitem": getitem,
    "year": _dt("cast(year({0}) as bigint)", "int"), "month": _dt("cast(month({0}) as bigint)", "int"), "day": _dt("cast(dayofmonth({0}) as bigint)", "int"),
    "yearmonth": _dt("cast(date_trunc('month', {0}) as timestamp_ntz)", "dt"),
    "quarter": _dt("concat(year({0}), '-Q', quarter({0}))", "str"), "weekday": _dt("date_format({0}, 'E')", "str"),
    "today": lambda a, t: ("cast(date_trunc('day', current_timestamp()) as timestamp_ntz)", "dt"),
    "now": lambda a, t: ("cast(current_timestamp() as timestamp_ntz)", "dt"),
    "parse_date": lambda a, t: ((f"cast(try_to_timestamp({a[0]}, {quoted(char_format(literal(a[1])))}) as timestamp_ntz)" if len(a) > 1 else datetime(a[0], t[0])), "dt"),
    "date_diff": _days,
    "date_add": lambda a, t: (f"{datetime(a[0], t[0])} + make_dt_interval(cast({a[1]} as int))", "dt"),
    "date_trunc": _trunc, "date_start": _trunc, "date_end": _end, "date_trunc_end": _end, "date_part": _part, "date_bin": _bin,
}
