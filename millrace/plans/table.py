"""A fluent, immutable query over a catalog, and the same query from JSON or the compact URL syntax.

Every step only adds to a lazy DataFrame plan; paths such as customer.nation.n_name join along declared keys.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog
from .predicates import all_of, boolean, condition, split_lookup

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
CALL = r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\(\s*(DISTINCT\s+)?(\*|[\w.]+)\s*\)"
AGGREGATE, CALLS = re.compile(rf"^\s*{CALL}\s*$", re.I), re.compile(CALL, re.I)


@dataclass(frozen=True)
class Table:
    catalog: Catalog
    name: str
    frame: DataFrame
    joined: tuple[str, ...]
    fields: tuple[tuple[Column, bool, str, str], ...] = ()
    groups: tuple[tuple[Column, str, str], ...] = ()
    havings: tuple[str, ...] = ()
    orders: tuple[Column, ...] = ()
    skip: int = 0
    most: int | None = None

    @classmethod
    def of(cls, catalog: Catalog, name: str) -> Table:
        return cls(catalog, name, catalog.frame(name).alias(name), (name,))

    def with_path(self, path: str) -> tuple[Table, Column]:
        """The query with the joins that a.b.column needs, and the column."""
        *tables, column = path.split(".")
        if not tables:
            return self, F.col(column)
        q, at = self, self.name
        for t in tables:
            if t != at and t not in q.joined:
                left, right, how = q.catalog.edge(at, t)
                q = replace(q, frame=q.frame.join(q.catalog.frame(t).alias(t), F.col(f"{at}.{left}") == F.col(f"{t}.{right}"), how), joined=(*q.joined, t))
            at = t
        return q, F.col(f"{at}.{column}")

    def has(self, path: str) -> bool:
        """Whether a bare name in a condition is a column."""
        if "." not in path:
            return path in self.frame.columns
        try:
            return bool(self.catalog.owner(self.name, path))
        except (ValueError, KeyError):
            return False

    def filter(self, text: str | None = None, /, **lookups) -> Table:
        q, wanted = self, []
        if text:
            def column(path):
                nonlocal q
                q, c = q.with_path(path)
                return c

            wanted.append(boolean(text, column, self.has))
        for name, value in lookups.items():
            path, op = split_lookup(name)
            q, c = q.with_path(path)
            wanted.append(condition(op, c, value))
        return replace(q, frame=q.frame.filter(all_of(wanted)))

    def join(self, table: str, left: str, right: str, how: str = "inner") -> Table:
        """Another table once; a second join to it is ignored."""
        if table in self.joined:
            return self
        on = F.col(left) == F.col(right)
        return replace(self, frame=self.frame.join(self.catalog.frame(table).alias(table), on, how), joined=(*self.joined, table))

    def field(self, text: str) -> tuple[Table, Column, bool, str, str]:
        """A column or an aggregate, `as` a name: the query with its joins, the column, whether it is an aggregate, its path and name."""
        body, _, alias = text.partition(" as ")
        if m := AGGREGATE.match(body):
            kind, distinct, path = m[1].lower(), m[2], m[3]
            q, c = (self, F.lit(1)) if path == "*" else self.with_path(path)
            made = F.count_distinct(c) if distinct else AGGREGATES[kind](c)
            name = alias.strip() or kind
            return q, made.alias(name), True, path, name
        path = body.strip()
        q, c = self.with_path(path)
        name = alias.strip() or path.split(".")[-1]
        return q, c.alias(name), False, path, name

    def values(self, *fields: str) -> Table:
        q = self
        for f in fields:
            q, *made = q.field(f)
            q = replace(q, fields=(*q.fields, tuple(made)))
        return q

    def group_by(self, *paths: str) -> Table:
        q = self
        for p in paths:
            q, c, aggregate, path, name = q.field(p)
            if aggregate:
                raise ValueError(f"cannot group by {p}")
            q = replace(q, groups=(*q.groups, (c, path, name)))
        return q

    def having(self, text: str) -> Table:
        return replace(self, havings=(*self.havings, text))

    def order_by(self, *names: str) -> Table:
        """name, -name, or `name ASC|DESC`; nulls first going up, last going down."""
        out = []
        for n in names:
            name, _, way = n.strip().lstrip("-").partition(" ")
            down = n.strip().startswith("-") or way.strip().upper() == "DESC"
            out.append(F.desc_nulls_last(name) if down else F.asc_nulls_first(name))
        return replace(self, orders=(*self.orders, *out))

    def limit(self, n: int) -> Table:
        return replace(self, most=None if n < 0 else n)

    def offset(self, n: int) -> Table:
        return replace(self, skip=n)

    def with_calls(self, text: str, first: int) -> tuple[Table, str, list[Column]]:
        """Aggregates in a HAVING text as hidden columns, with the joins that their paths need; the text names those columns."""
        q, calls = self, []

        def named(m):
            nonlocal q
            q, c, *_ = q.field(m[0])
            calls.append(c.alias(f"_having_{first + len(calls)}"))
            return f"_having_{first + len(calls) - 1}"

        text = CALLS.sub(named, text)
        return q, text, calls

    def grouped(self) -> DataFrame:
        q, texts, calls = self, [], []
        for text in self.havings:
            q, text, more = q.with_calls(text, len(calls))
            texts.append(text)
            calls += more
        by = {path: name for _, path, name in q.groups}
        for _, aggregate, path, name in q.fields:
            if not aggregate and path not in by:
                raise ValueError(f"{path} is neither grouped nor aggregated")
        made = [c for c, aggregate, *_ in q.fields if aggregate] + calls
        df = q.frame.groupBy(*(c for c, *_ in q.groups)).agg(*made) if made else q.frame.select(*(c for c, *_ in q.groups)).distinct()
        # a path of a grouped column names that column; anything else is an output name
        for text in texts:
            df = df.filter(boolean(text, lambda p: F.col(f"`{by.get(p, p.split('.')[-1])}`"), lambda p: p in df.columns))
        if any(not aggregate for _, aggregate, *_ in q.fields):
            return df.select(*(F.col(f"`{name}`") if aggregate else F.col(f"`{by[path]}`").alias(name) for _, aggregate, path, name in q.fields))
        return df.drop(*(f"_having_{i}" for i in range(len(calls))))

    def frame_of(self) -> DataFrame:
        df = self.frame
        if self.groups or self.havings or any(aggregate for _, aggregate, *_ in self.fields):
            df = self.grouped()
        elif self.fields:
            df = df.select(*(c for c, *_ in self.fields))
        elif len(self.joined) > 1:
            df = df.select(f"{self.name}.*")
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)

    def count(self) -> int:
        return self.frame_of().count()


@dataclass(frozen=True)
class Field:
    """What requests may do with a column; a hidden one isn't there for them."""

    read: bool = True
    write: bool = False
    filter: bool = True
    sort: bool = True
    hidden: bool = False


@dataclass(frozen=True)
class Rights:
    """What requests may do with a table."""

    fields: dict[str, Field]
    read: bool = True
    write: bool = False
    delete: bool = False


@dataclass(frozen=True)
class Policy:
    """Rights by table (a tuple of names: those may be read, filtered and sorted by), and the row limits."""

    tables: dict[str, tuple[str, ...] | Rights]
    default_limit: int = 100
    max_limit: int = 1000

    def rights(self, table: str) -> Rights:
        if table not in self.tables:
            raise PermissionError(f"table {table} is not readable")
        held = self.tables[table]
        return held if isinstance(held, Rights) else Rights({f: Field() for f in held})

    def require(self, table: str, use: str) -> None:
        if not getattr(self.rights(table), use):
            raise PermissionError(f"table {table}: no right to {use}")

    def check(self, catalog: Catalog, table: str, path: str, use: str = "read") -> None:
        """Every table on the way must be readable, and the last one's column must allow the use."""
        for t in path.split(".")[:-1]:
            self.require(t, "read")
        owner, column = catalog.owner(table, path)
        self.require(owner, "read")
        field = self.rights(owner).fields.get(column)
        if field is None or field.hidden or not getattr(field, use):
            raise PermissionError(f"field {path}: no right to {use}")

    def readable(self, table: str) -> list[str]:
        self.require(table, "read")
        return [n for n, f in self.rights(table).fields.items() if f.read and not f.hidden]

    def clamp(self, n: int | None) -> int:
        return min(self.max_limit, max(1, self.default_limit if n is None else n))


@dataclass(frozen=True)
class Request:
    """A read request in parts, whatever syntax it came in. where: (path, operator, value); filters: condition texts."""

    table: str
    fields: tuple[str, ...] = ()
    where: tuple[tuple[str, str, object], ...] = ()
    filters: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[str, ...] = ()
    orders: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0

    def allowed(self, catalog: Catalog, policy: Policy) -> Request:
        """The request with its limit clamped and no fields made the readable ones; PermissionError for anything that isn't allowed."""
        policy.require(self.table, "read")
        fields = self.fields or (() if self.groups else tuple(policy.readable(self.table)))
        names, calls = set(), []
        for text in fields:
            body, _, alias = text.partition(" as ")
            m = AGGREGATE.match(body)
            path = m[3] if m else body.strip()
            calls.append(path)
            names.add(alias.strip() or (m[1].lower() if m else path.split(".")[-1]))
        grouped = {g.partition(" as ")[0].strip() for g in self.groups}
        names |= {g.partition(" as ")[2].strip() or g.strip().split(".")[-1] for g in self.groups}
        reads = [*calls, *grouped, *(m[3] for text in self.havings for m in CALLS.finditer(text))]
        for path in reads:
            if path != "*":
                policy.check(catalog, self.table, path)
        here = Table.of(catalog, self.table)
        conditions = [p for p, _, _ in self.where]
        for text in self.filters:
            boolean(text, lambda p: conditions.append(p) or F.lit(0), here.has)
        for path in conditions:
            policy.check(catalog, self.table, path, "filter")
        for text in self.havings:
            used: list[str] = []
            boolean(CALLS.sub("_call", text), lambda p: used.append(p) or F.lit(0), here.has)
            for path in used:
                if path != "_call" and path not in names and path not in grouped:
                    policy.check(catalog, self.table, path)
        for text in self.orders:
            name = text.strip().lstrip("-").partition(" ")[0]
            if name not in names - {f.split(".")[-1] for f in calls if f != "*"}:  # a name of the request's own, over what it may read
                policy.check(catalog, self.table, name, "sort")
        return replace(self, fields=fields, limit=policy.clamp(self.limit))

    def frame(self, catalog: Catalog, policy: Policy | None = None) -> DataFrame:
        r = self.allowed(catalog, policy) if policy else self
        q = Table.of(catalog, r.table)
        for path, op, value in r.where:
            q, c = q.with_path(path)
            q = replace(q, frame=q.frame.filter(condition(op, c, value)))
        for text in r.filters:
            q = q.filter(text)
        q = q.values(*r.fields).group_by(*r.groups).order_by(*r.orders)
        for text in r.havings:
            q = q.having(text)
        return q.offset(r.offset).limit(-1 if r.limit is None else r.limit).frame_of()


def from_json(catalog: Catalog, body: str | dict, policy: Policy | None = None) -> DataFrame:
    """{table, fields, where: [{field, op, value}], group_by, having, order_by, limit, offset}; aggregates in fields."""
    body = json.loads(body) if isinstance(body, str) else body
    body = {**body, **body.get("query", {})}
    get = lambda k: tuple(body.get(k, ()))
    where = tuple((w["field"], w["op"], w["value"]) for w in get("where"))
    return Request(body["table"], get("fields"), where, (), get("group_by"), get("having"), get("order_by"), body.get("limit"), body.get("offset", 0)).frame(catalog, policy)


def from_url(catalog: Catalog, text: str, policy: Policy | None = None) -> DataFrame:
    """`table:[orders];fields:[a,b];filter:[x>1,y='z'];groups:[a];having:[COUNT(*)>1];order_by:[a ASC];limit:[5];offset:[10]`, in parentheses or after query=."""
    text = re.sub(r"^.*?query=([^&]*).*$", r"\1", text, flags=re.S).strip().removeprefix("(").removesuffix(")")
    parts = {k: tuple(x.strip() for x in re.findall(r"(?:'(?:[^']|'')*'|[^,'])+", v)) for k, v in re.findall(r"(\w+):\[((?:'(?:[^']|'')*'|[^\]'])*)\]", text)}
    get = lambda k: parts.get(k, ())
    limit, offset = (int(get(k)[0]) if get(k) else None for k in ("limit", "offset"))
    return Request(parts["table"][0], get("fields"), (), get("filter"), get("groups"), get("having"), get("order_by"), limit, offset or 0).frame(catalog, policy)


RESERVED = ("values", "group_by", "having", "order_by", "limit", "offset")


def from_params(catalog: Catalog, table: str, params: dict[str, str], policy: Policy | None = None) -> DataFrame:
    """A table by query-string parameters: field or field__op by value; those of RESERVED are lists with commas."""
    listed = lambda k: tuple(x.strip() for x in params[k].split(",")) if params.get(k) else ()
    where = []
    for name, value in params.items():
        if name not in RESERVED:
            path, op = split_lookup(name)
            where.append((path, op, value.split(",") if op == "in" else value))
    number = lambda k: int(params[k]) if params.get(k) else None
    return Request(table, listed("values"), tuple(where), (), listed("group_by"), listed("having"), listed("order_by"), number("limit"), number("offset") or 0).frame(catalog, policy)


def payload(body: str | dict) -> dict:
    """The row that a write request carries: its data, or the body itself if it has none of a request's keys."""
    body = json.loads(body) if isinstance(body, str) else body
    return body if not {"method", "table", "query", "data"} & set(body) else body.get("data", {})


def written(catalog: Catalog, method: str, table: str, body: str | dict, policy: Policy | None = None, where: dict | None = None, key: str | None = None) -> DataFrame:
    """The table's rows after POST (a row more), PUT or PATCH (columns set) or DELETE of the rows that where's equalities choose.

    All but POST need a condition. policy: write or delete on the table, write on each column set, filter on those of where.
    """
    from ..operators import changes

    method, values, rows = method.upper(), payload(body) if method.upper() != "DELETE" else {}, catalog.frame(table)
    for name in [*values, *(where or ())]:
        catalog.owner(table, name)
    if policy:
        policy.require(table, "delete" if method == "DELETE" else "write")
        for name in values:
            policy.check(catalog, table, name, "write")
        for name in where or ():
            policy.check(catalog, table, name, "filter")
    if method == "POST":
        spark = rows.sparkSession
        one = spark.createDataFrame([("x",)], "x string").select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema))
        return changes.insert(rows, one, key)
    if not where:
        raise ValueError(f"{method} needs a condition")
    chosen = all_of([condition("eq", F.col(n), v) for n, v in where.items()])
    if method == "DELETE":
        return changes.remove(rows, chosen)
    if method not in ("PUT", "PATCH"):
        raise ValueError(f"unknown method {method}")
    return changes.update(rows, chosen, {n: F.lit(v).cast(rows.schema[n].dataType) for n, v in values.items()})
