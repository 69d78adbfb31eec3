"""The session: a catalogue of tables over a SparkSession, and execution of scripts."""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions import aggregates as agg
from tessera.functions import types as ty
from tessera.operators.pivot import pivot_by
from tessera.plans import ast as a
from tessera.plans.lexer import QueryError
from tessera.plans.lower import Block, Lowering, Scope, Table, name_of, own_cast
from tessera.plans.parser import parse

_NUMBER = itertools.count()
#: Statements that change a table after which its lineage is cut.
CUT_AFTER = 50


class StatementError(QueryError):
    """A script that cannot be parsed."""


class ConstraintError(QueryError):
    """A row that violates a constraint of its table."""


@dataclass
class Entry:
    """A table: its data, its columns' types and what rows must hold to."""

    frame: DataFrame
    columns: dict[str, str]
    defaults: dict[str, object] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    checks: list[tuple[str, object]] = field(default_factory=list)
    #: columns made when the table is read: name -> (SQL over the stored columns, type)
    computed: dict[str, tuple[str, str]] = field(default_factory=dict)
    view: str = ""
    changes: int = 0


class Session:
    """``default_table`` is read by a SELECT without FROM; ``implicit_group`` adds what is not
    aggregated to GROUP BY; ``expand`` lets ``*`` expand datetimes to their attributes."""

    def __init__(self, spark: SparkSession, default_table: str | None = None, implicit_group: bool = True, expand: bool = True):
        self.spark, self.default_table, self.implicit_group, self.expand = spark, default_table, implicit_group, expand
        self.tables: dict[str, Entry] = {}
        self.settings: dict[str, str] = {}
        self.functions: dict = {}
        self.aggregates: dict = {}
        self.overloads: dict[str, list] = {}
        self.operators: dict = {}

    def copy(self) -> Session:
        """A session over the same data: statements in one do not show in the other, as tables are
        replaced and never changed."""
        other = Session(self.spark, self.default_table, self.implicit_group, self.expand)
        other.settings, other.functions, other.aggregates = dict(self.settings), dict(self.functions), dict(self.aggregates)
        other.overloads, other.operators = {name: list(found) for name, found in self.overloads.items()}, dict(self.operators)
        for name, e in self.tables.items():
            other._put(name, Entry(e.frame, dict(e.columns), dict(e.defaults), list(e.not_null), list(e.checks), dict(e.computed)))
        return other

    # catalogue
    def register(self, name: str, frame: DataFrame, **constraints) -> Session:
        """A table over any DataFrame (a file, a query, in-memory rows). Timestamps lose their
        zone, as the dialect's are in UTC."""
        casts = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in frame.schema if isinstance(f.dataType, (t.TimestampType, t.DateType))}
        frame = frame.withColumns(casts) if casts else frame
        entry = Entry(frame, {f.name: ty.from_spark(f.dataType) for f in frame.schema}, **constraints)
        self._put(name, entry)
        return self

    def _put(self, name: str, entry: Entry) -> None:
        entry.view = f"tessera_{next(_NUMBER)}"
        entry.frame.withColumns({c: F.expr(sql) for c, (sql, _) in entry.computed.items()}).createOrReplaceTempView(entry.view)
        self.tables[name.lower()] = entry

    def table(self, name: str) -> Entry:
        found = self.tables.get(name.lower())
        if not found:
            raise QueryError(f'relation "{name}" does not exist')
        return found

    def _called(self, fn, sql):
        if fn is None:
            return sql
        unique = f"tessera_fn_{next(_NUMBER)}"
        self.spark.udf.register(unique, fn)
        return lambda *args: f"{unique}({', '.join(args)})"

    def register_function(self, name: str, out: str, fn=None, sql=None, args: list[str] | None = None, variadic: bool = False) -> None:
        """A scalar function of the user's: ``sql`` builds Spark SQL from the arguments' SQL, which
        stays in the JVM; ``fn`` is a Python function (a pandas UDF or a plain one, marked as not
        deterministic by Spark's own means) for the rest. With ``args``, the types of its arguments,
        it is one of several overloads: the first whose types fit takes the call, exact ones before
        those that an integer widens to; ``variadic``: the last type stands for any number more."""
        low, call, result = name.lower(), self._called(fn, sql), ty.of_name(out) or out
        if args is None:
            self.functions[low] = lambda found, kinds: (call(*found), result)
            return
        wanted = [ty.of_name(k) or k for k in args]
        mine = self.overloads.setdefault(low, [])
        mine.append((wanted, variadic, call, result))

        def choose(found, kinds):
            for exact in (True, False):
                for own, many, make, to in mine:
                    types = own[:-1] + own[-1:] * max(0, len(kinds) - len(own) + 1) if many else own
                    fits = lambda have, want: have in (want, "null") or not exact and (want == "obj" or have == "int" and want in ("num", "dec"))  # noqa: E731, B023
                    if len(types) == len(kinds) and all(map(fits, kinds, types)):
                        return make(*found), to
            raise QueryError(f"no overload of {name} takes ({', '.join(kinds)})")

        self.functions[low] = choose

    def register_aggregate(self, name: str, out: str, fn=None, sql=None) -> None:
        """An aggregate of the user's, for groups and windows, with FILTER: ``sql`` builds Spark SQL
        from the arguments' SQL (an expression of Spark's aggregates, merged from partial ones; one of
        several aggregates marks each by `` OVER ()``, where a window goes); ``fn`` is a pandas UDF from
        columns to one value, which gathers a group in one task. Under FILTER the values of other rows
        are null."""
        agg.USER.add(name.lower())
        self.aggregates[name.lower()] = (self._called(fn, sql), ty.of_name(out) or out)

    def register_operator(self, op: str, args: list[str], out: str, sql) -> None:
        """A unary or binary operator of the dialect for operands of exactly these types: ``sql``
        builds Spark SQL from theirs. It goes before what the operator does with them otherwise."""
        self.operators[op.lower(), *(ty.of_name(k) or k for k in args)] = sql, ty.of_name(out) or out

    @staticmethod
    def register_type(name: str, like: str, aliases: tuple[str, ...] = (), cast=None, attributes: dict | None = None) -> None:
        """A type, known to all sessions, for columns and casts under ``name`` and ``aliases``, stored
        as the type ``like``. ``cast`` builds SQL from a value's SQL and type; ``attributes`` gives for
        each name a builder of SQL from the value's SQL, and a type. Values compare as those of
        ``like``; other operators are registered for it."""
        kind = name.lower()
        if kind in ty.NAMES or kind in ty.SPARK:
            raise QueryError(f"type {name!r} is one of the dialect's own")
        ty.OWN[kind] = ty.Own(ty.of_name(like) or like, cast, {k.lower(): (make, ty.of_name(to) or to) for k, (make, to) in (attributes or {}).items()})
        ty.OWN_NAMES.update({n.lower(): kind for n in (name, *aliases)})

    def computed_column(self, table: str, name: str, text: str) -> Session:
        """A column that is made of the stored ones, by an expression of the dialect, whenever the
        table is read; a stored column of this name shows where the expression is null. It is no
        target of INSERT and UPDATE, and their conditions do not see it."""
        entry = self.table(table)
        sql, kind = self._expr(table, parse(f"SELECT {text}")[0].items[0][0])
        stored = next((c for c in entry.columns if c.lower() == name.lower()), None)
        if stored:
            sql = f"coalesce({sql}, {name_of(stored)})"
        entry.computed[stored or name] = sql, kind
        self._put(table, entry)
        return self

    # execution
    def prepare(self, text: str) -> list:
        settings = dict(self.settings)
        try:
            found = parse(text, settings.get("identifier_quoting", "auto"))
            for s in found:
                if isinstance(s, a.Setting):
                    settings[s.name] = s.value
            return parse(text, settings["identifier_quoting"]) if "identifier_quoting" in settings else found
        except QueryError as e:
            raise StatementError(str(e)) from e

    def execute(self, text: str | list, params: list | tuple | dict | None = None) -> DataFrame | None:
        """Runs a script; the last statement's result is returned, lazily if it is a query."""
        result = None
        for statement in self.prepare(text) if isinstance(text, str) else text:
            result = self._run(statement, params)
        return result

    sql = execute

    def lowering(self, params=None) -> Lowering:
        known = {name: (e.view, e.columns | {c: kind for c, (_, kind) in e.computed.items()}) for name, e in self.tables.items()}
        return Lowering(known, params, self.implicit_group, self.default_table, self.expand, self.functions, self.aggregates, self.operators, self.spark)

    def lowered(self, query: a.Query, params=None) -> Block:
        own = self.lowering(params)
        block = own.query(query)
        used = getattr(query, "positional", 0)
        if isinstance(params, (list, tuple)) and used != len(params):
            raise QueryError(f"the query uses {used} parameters, not {len(params)}")
        return block

    def _run(self, s, params) -> DataFrame | None:
        match s:
            case a.Query():
                block = self.lowered(s, params)
                frame = self.spark.sql(block.sql)
                return pivot_by(frame, *block.pivot) if block.pivot else frame
            case a.Setting():
                self.settings[s.name] = s.value
            case a.Create():
                return self._create(s, params)
            case a.Insert():
                return self._insert(s, params)
            case a.Update():
                return self._update(s, params)
            case a.Delete():
                entry = self.table(s.table)
                gone = self._where(s.table, s.where, params)
                return self._replace(s.table, entry, entry.frame.where(f"NOT coalesce({gone}, false)"), entry.frame.where(gone).count())
            case a.Drop():
                if not s.if_exists:
                    self.table(s.table)
                self.tables.pop(s.table.lower(), None)
        return None

    def _scope(self, name: str) -> Scope:
        entry = self.table(name)
        return Scope([Table(name, entry.columns, {name.lower()})])

    def _expr(self, name: str, e, params=None) -> tuple[str, str]:
        """SQL over a table's own columns."""
        sql, kind = self.lowering(params).expr(e, self._scope(name))
        return sql.replace(f"{name_of(name)}.", ""), kind

    def _where(self, name: str, e, params) -> str:
        return "TRUE" if e is None else self._expr(name, e, params)[0]

    def _create(self, s: a.Create, params) -> DataFrame:
        if s.name.lower() in self.tables:
            if s.if_not_exists:
                return self.spark.sql("SELECT 1 AS result")
            raise QueryError(f'relation "{s.name}" already exists')
        if s.query is not None:
            self.register(s.name, self._run(s.query, params))
            return self.spark.sql("SELECT 1 AS result")
        columns, kinds = {}, []
        for c in s.columns:
            kind = ty.of_name(c.kind)
            if not kind:
                raise QueryError(f"unrecognized type {c.kind!r}")
            columns[c.name] = kind
            kinds.append(f"{name_of(c.name)} {ty.to_spark(kind, c.size)}")
        entry = Entry(self.spark.createDataFrame([], ", ".join(kinds)), columns)
        entry.defaults = {c.name: c.default for c in s.columns if c.default is not None}
        entry.not_null = [c.name for c in s.columns if c.not_null]
        entry.checks = [(f"{s.name}_{c.name}_check", e) for c in s.columns for e in c.checks] + [(f"{s.name}_check", e) for e in s.checks]
        self._put(s.name, entry)
        return self.spark.sql("SELECT 1 AS result")

    def _validate(self, name: str, frame: DataFrame) -> None:
        entry = self.table(name)
        rules = [("not-null", c, f"{name_of(c)} IS NULL") for c in entry.not_null]
        rules += [(label, None, f"NOT ({self._expr(name, e)[0]})") for label, e in entry.checks]
        if not rules:
            return
        broken = frame.agg(*(F.max(F.expr(f"coalesce({test}, false)")) for *_, test in rules)).first()
        for (label, column, _), bad in zip(rules, broken, strict=True):
            if bad and label == "not-null":
                raise ConstraintError(f'null value in column "{column}" of relation "{name}" violates not-null constraint')
            if bad:
                raise ConstraintError(f'new row for relation "{name}" violates check constraint "{label}"')

    def _replace(self, name: str, entry: Entry, frame: DataFrame, n: int, returned: DataFrame | None = None) -> DataFrame:
        entry.changes += 1
        if entry.changes % CUT_AFTER == 0:  # bounds the lineage
            if self.spark.sparkContext.getCheckpointDir() is None:
                folder = self.spark.conf.get("spark.checkpoint.dir", None)
                if folder:
                    self.spark.sparkContext.setCheckpointDir(folder)
            if self.spark.sparkContext.getCheckpointDir() is not None:
                frame = frame.checkpoint()
        entry.frame = frame
        self._put(name, entry)
        return returned if returned is not None else self.spark.sql(f"SELECT cast({n} as bigint) AS count")

    def _insert(self, s: a.Insert, params) -> DataFrame:
        entry, own = self.table(s.table), self.lowering(params)
        names = s.columns or list(entry.columns)
        low = {c.lower(): c for c in entry.columns}
        for c in names:
            if c.lower() not in low:
                raise QueryError(f'column "{c}" of relation "{s.table}" does not exist')
        given = [low[c.lower()] for c in names]
        rows = []
        for row in s.rows:
            if len(row) != len(given):
                raise QueryError("INSERT has more expressions than target columns" if len(row) > len(given) else "INSERT has more target columns than expressions")
            values = dict(zip(given, row, strict=True))
            out = []
            for c, kind in entry.columns.items():
                e = values.get(c, a.Lit(None, "null"))
                if e == a.Lit(None, "null") and c in entry.defaults:
                    e = entry.defaults[c]
                sql, from_ = own.expr(e, Scope([]))
                if kind in ty.OWN:
                    sql = own_cast(kind, sql, from_)
                elif from_ != kind and from_ != "null" and kind in ("dt", "num", "int", "dec", "str", "bool"):
                    sql = own.functions[{"dt": "datetime", "num": "number", "int": "int", "dec": "numeric", "str": "text", "bool": "boolean"}[kind]]([sql], [from_])[0]
                out.append(sql)
            rows.append("(" + ", ".join(out) + ")")
        kinds = {f.name: f.dataType.simpleString() for f in entry.frame.schema}
        columns = ", ".join(f"cast({name_of(c)} as {kinds[c]}) AS {name_of(c)}" for c in entry.columns)
        fresh = self.spark.sql(f"SELECT {columns} FROM VALUES {', '.join(rows)} AS v({', '.join(map(name_of, entry.columns))})")
        self._validate(s.table, fresh)
        returned = self._returned(s.table, s.returning, fresh)
        return self._replace(s.table, entry, entry.frame.unionByName(fresh), len(rows), returned)

    def _returned(self, name: str, items: list, frame: DataFrame) -> DataFrame | None:
        if not items:
            return None
        other = Session(self.spark, expand=self.expand)
        other._put(name, Entry(frame, self.table(name).columns))
        return other._run(a.Query(items=items, source=a.Source(name)), None)

    def _update(self, s: a.Update, params) -> DataFrame:
        entry = self.table(s.table)
        hit = f"coalesce({self._where(s.table, s.where, params)}, false)"
        kinds = {f.name: f.dataType.simpleString() for f in entry.frame.schema}
        changed = entry.frame.withColumn("__hit", F.expr(hit))
        for c, e in s.sets:  # later items see earlier ones
            column = next((x for x in entry.columns if x.lower() == c.lower()), None)
            if column is None:
                raise QueryError(f'column "{c}" of relation "{s.table}" does not exist')
            value = self._expr(s.table, e, params)[0]
            changed = changed.withColumn(column, F.expr(f"if(__hit, cast({value} as {kinds[column]}), {name_of(column)})"))
        rows = changed.where("__hit").drop("__hit")
        self._validate(s.table, rows)
        n = rows.count()
        return self._replace(s.table, entry, changed.drop("__hit"), n, self._returned(s.table, s.returning, rows))

    # models as JSON
    def to_model(self, name: str) -> dict:
        """A table as a JSON-able model: for small tables; large ones are written as files."""
        entry = self.table(name)
        kinds = {v: k for k, v in {"integer": "int", "number": "num", "numeric": "dec", "boolean": "bool", "string": "str", "datetime": "dt", "interval": "dur", "object": "obj"}.items()}
        columns = [{"name": c, "type": kinds.get(k, k)} for c, k in entry.columns.items()]
        return {"name": name, "columns": columns, "constraints": {"notNull": list(entry.not_null)}, "data": [json.loads(r) for r in entry.frame.toJSON().collect()]}

    @classmethod
    def from_models(cls, spark: SparkSession, models: dict[str, dict], **options) -> Session:
        """A session of tables given as models by name; rows are coerced and validated."""
        session = cls(spark, **options)
        for name, model in models.items():
            if model["name"] != name:
                raise QueryError(f"table {model['name']!r} is given under the name {name!r}")
            kinds = {c["name"]: ty.of_name(c["type"]) for c in model["columns"]}
            raw = spark.createDataFrame([[None if (v := row.get(c)) is None else str(v).lower() if isinstance(v, bool) else str(v) for c in kinds] for row in model.get("data", [])], ", ".join(f"{name_of(c)} string" for c in kinds))
            frame = raw.select(*(F.expr(f"try_cast({name_of(c)} as {ty.to_spark(k)})").alias(c) for c, k in kinds.items()))
            constraints = model.get("constraints", {})
            checks = [(f"{name}_check", parse(f"SELECT {text}")[0].items[0][0]) for text in constraints.get("check", [])]
            session._put(name, Entry(frame, kinds, not_null=list(constraints.get("notNull", [])), checks=checks))
            session._validate(name, frame)
        return session
