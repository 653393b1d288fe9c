"""SPARQL SELECT over a triple table, as a DataFrame: Catalyst plans the joins.

Covered: PREFIX, ASK, SELECT [DISTINCT] with variables and aggregates (COUNT,
SAMPLE, MIN, MAX, SUM, AVG), basic patterns with ';' and ',', property paths
(/ * + ^), OPTIONAL, UNION, FILTER, [NOT] EXISTS, BIND, VALUES, MINUS, LANG and
LANGMATCHES, nested groups, GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET. SAMPLE is
the minimum, so results do not vary. Values are strings; comparisons of numbers
cast both sides. Patterns without a shared variable are combined where one of
them has at most MAX_LOOSE rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .graph_build import of
from .graph_query import path_plus

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?:@(?P<lang>[A-Za-z-]+)|\^\^(?:<[^>]*>|[\w-]*:[\w-]*))?|(?P<var>[?$]\w+)|(?P<num>\d+(?:\.\d+)?)|(?P<op>&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*+/^|-])|(?P<name>[A-Za-z_][\w-]*:[\w.-]*[\w-]|[A-Za-z_]?[\w-]*:[\w-]*|[A-Za-z_]\w*)""",
    re.X,
)
MAX_LOOSE = 10_000
AGGREGATES = {"COUNT", "SAMPLE", "MIN", "MAX", "SUM", "AVG"}


def sparql(triples: DataFrame, query: str) -> DataFrame:
    """The rows of a SELECT query; columns are the selected variables, in order. Of an ASK query: one row, ask."""
    return _Parser(query, triples).query()


class _Parser:
    def __init__(self, text: str, triples: DataFrame):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"SPARQL at {at}: {text[at : at + 30]!r}")
            at = m.end()
            if kind := next((k for k in ("iri", "str", "var", "num", "op", "name") if m[k] is not None), None):
                self.tokens.append((kind, m[kind]))
        self.at, self.triples, self.prefixes, self.fresh = 0, triples, {}, 0
        self.langs = ("name", "LANG") in [(k, t.upper()) for k, t in self.tokens]  # else languages are not carried

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def word(self, *words: str) -> str | None:
        """Takes the next token if it is one of these words or signs."""
        kind, t = self.peek()
        if (kind in ("name", "op")) and t.upper() in words:
            self.at += 1
            return t.upper()
        return None

    def expect(self, *words: str) -> str:
        if (t := self.word(*words)) is None:
            raise ValueError(f"expected {' or '.join(words)}, found {self.peek()[1]!r}")
        return t

    def iri(self, kind: str, t: str) -> str:
        if kind == "iri":
            return t[1:-1]
        if t == "a":
            return V.RDF_TYPE
        head, _, tail = t.partition(":")
        if head not in self.prefixes:
            raise ValueError(f"unknown prefix {head!r}")
        return self.prefixes[head] + tail

    # -- query

    def query(self) -> DataFrame:
        while self.word("PREFIX"):
            name = self.next()[1]
            self.prefixes[name.rstrip(":")] = self.next()[1][1:-1]
        if not self.word("ASK"):
            return self.select()
        self.word("WHERE")
        found = self.group()
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return found.limit(1).agg((F.count("*") > 0).alias("ask"))

    def select(self) -> DataFrame:
        self.expect("SELECT")
        distinct = bool(self.word("DISTINCT"))
        items: list[tuple[str, Column | None, bool]] = []
        star = bool(self.word("*"))
        while not star and self.peek()[1].upper() not in ("WHERE", "{"):
            if self.word("("):
                value, is_agg = self.aggregate_or_expr()
                self.expect("AS")
                items.append((self.next()[1][1:], value, is_agg))
                self.expect(")")
            else:
                items.append((self.next()[1][1:], None, False))
        self.word("WHERE")
        df = self.group()
        keys: list[str] = []
        if self.word("GROUP"):
            self.expect("BY")
            while self.peek()[0] == "var":
                keys.append(self.next()[1][1:])
        if any(agg for *_, agg in items) or keys:
            aggs = [value.alias(name) for name, value, agg in items if agg]
            df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        else:
            for name, value, _ in items:
                if value is not None:
                    df = df.withColumn(name, value)
        if self.word("HAVING"):
            self.expect("(")
            df = df.filter(self.expr())
            self.expect(")")
        names = [c for c in df.columns if not c.startswith("_")] if star else [name for name, *_ in items]
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        orders = []
        if self.word("ORDER"):
            self.expect("BY")
            while self.peek()[1].upper() not in ("LIMIT", "OFFSET", ""):
                way = self.word("ASC", "DESC")
                c = self.primary()
                orders.append(c.desc_nulls_last() if way == "DESC" else c.asc_nulls_first())
        if distinct:
            df = df.select(*names).distinct()
        if orders:
            df = df.orderBy(*orders)
        limit = offset = None
        while t := self.word("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            limit, offset = (n, offset) if t == "LIMIT" else (limit, n)
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit is not None else df
        if self.peek()[0] != "end":
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return df.select(*names)

    def group(self) -> DataFrame:
        self.expect("{")
        df: DataFrame | None = None
        filters: list[Column | tuple[str, DataFrame]] = []
        while not self.word("}"):
            if self.word("."):
                continue
            if self.word("FILTER"):
                how = "left_anti" if self.word("NOT") else "left_semi"
                if how == "left_anti" or self.peek()[1].upper() == "EXISTS":
                    self.expect("EXISTS")
                    filters.append((how, self.group()))
                else:
                    filters.append(self.primary())
            elif self.word("OPTIONAL"):
                df = self.join(df, self.group(), "left")
            elif self.word("MINUS"):
                other = self.group()
                if shared := self.shared(df, other):  # groups without a shared variable take nothing away
                    df = df.join(other, shared, "left_anti")
            elif self.word("BIND"):
                self.expect("(")
                value = self.expr()
                self.expect("AS")
                df = (df if df is not None else self.unit()).withColumn(self.next()[1][1:], value.cast("string"))
                self.expect(")")
            elif self.word("VALUES"):
                df = self.join(df, self.inline())
            elif self.peek()[1] == "{":
                part = self.group()
                while self.word("UNION"):
                    part = part.unionByName(self.group(), allowMissingColumns=True)
                df = self.join(df, part)
            else:
                df = self.patterns(df)
        df = df if df is not None else self.unit()
        for f in filters:
            if isinstance(f, tuple):
                how, other = f
                shared = self.shared(df, other)
                df = df.join(other, shared, how) if shared else df.join(other.select(F.lit(1).alias("_any")).limit(1), F.lit(True), how)
            else:
                df = df.filter(f)
        return df

    @staticmethod
    def shared(a: DataFrame, b: DataFrame) -> list[str]:
        return [c for c in b.columns if c in a.columns and not c.startswith("_lang_")]

    def unit(self) -> DataFrame:
        return self.triples.sparkSession.range(1).select(F.lit(1).alias("_unit"))

    def join(self, a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        if a is None:
            return b
        shared = self.shared(a, b)
        b = b.drop(*[c for c in b.columns if c in a.columns and c not in shared])
        if shared:
            return a.join(b, shared, how)
        if b.limit(MAX_LOOSE + 1).count() <= MAX_LOOSE:
            return a.join(F.broadcast(b), F.lit(True), how)
        if how == "inner" and a.limit(MAX_LOOSE + 1).count() <= MAX_LOOSE:
            return F.broadcast(a).join(b, F.lit(True))
        raise ValueError(f"patterns without a shared variable, and with more than {MAX_LOOSE} rows each")

    def inline(self) -> DataFrame:
        many = bool(self.word("("))
        names = []
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
        if many:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.word("}"):
            if many:
                self.expect("(")
            rows.append(tuple(self.constant() for _ in names))
            if many:
                self.expect(")")
        return F.broadcast(self.triples.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))

    def constant(self) -> str | None:
        kind, t = self.next()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if kind == "num":
            return t
        return None if t.upper() == "UNDEF" else self.iri(kind, t)

    def patterns(self, df: DataFrame | None) -> DataFrame:
        s = self.node()
        while True:
            path = self.path()
            while True:
                df = self.join(df, self.edge(s, path, self.node()))
                if not self.word(","):
                    break
            if not self.word(";"):
                return df
            if self.peek()[1] in (".", "}"):
                return df

    def node(self) -> tuple[str, str]:
        kind, t = self.peek()
        if kind == "var":
            self.at += 1
            return "var", t[1:]
        return "const", self.constant()

    def path(self) -> list[tuple[str, str, bool]]:
        """Steps: IRI (or ?variable), repetition, inverse."""
        steps = []
        while True:
            inverse = bool(self.word("^"))
            kind, t = self.next()
            p = t if kind == "var" else self.iri(kind, t)
            steps.append((p, self.word("*", "+") or "", inverse))
            if not self.word("/"):
                return steps

    def edge(self, s: tuple[str, str], path: list, o: tuple[str, str]) -> DataFrame:
        ends = [s]
        for _ in path[1:]:
            self.fresh += 1
            ends.append(("var", f"_p{self.fresh}"))
        ends.append(o)
        out = None
        for (p, times, inverse), a, b in zip(path, ends, ends[1:], strict=False):
            a, b = (b, a) if inverse else (a, b)
            out = self.join(out, self.step(a, p, times, b))
        return out.select(*[c for c in out.columns if not c.startswith("_p")]).distinct() if len(path) > 1 else out

    def step(self, a: tuple[str, str], p: str, times: str, b: tuple[str, str]) -> DataFrame:
        t, extra = self.triples, []
        if times:
            rows = path_plus(t, p)
            if times == "*":
                spark = t.sparkSession
                nodes = t.select(F.col("s").alias("a")).union(t.filter("o_kind <> 'lit'").select("o"))
                for kind, x in (a, b):
                    if kind == "const":  # a constant matches itself, in the graph or not
                        nodes = nodes.union(spark.createDataFrame([(x,)], "a string"))
                rows = rows.unionByName(nodes.distinct().select("a", F.col("a").alias("b"))).distinct()
        elif p.startswith("?"):
            rows, extra = t.select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("p").alias(p[1:]), "o_lang"), [p[1:]]
        else:
            rows = of(t, p).select(F.col("s").alias("a"), F.col("o").alias("b"), "o_lang")
        if self.langs and not times and b[0] == "var":
            extra = [*extra, F.col("o_lang").alias(f"_lang_{b[1]}")]
        cols = []
        for place, (kind, x) in (("a", a), ("b", b)):
            if kind == "const":
                rows = rows.filter(F.col(place) == x)
            else:
                cols.append((place, x))
        if len(cols) == 2 and cols[0][1] == cols[1][1]:
            rows, cols = rows.filter("a = b"), cols[:1]
        out = rows.select(*[F.col(c).alias(v) for c, v in cols], *extra) if cols or extra else rows.select(F.lit(1).alias("_unit")).limit(1)
        return out

    # -- expressions

    def aggregate_or_expr(self) -> tuple[Column, bool]:
        kind, t = self.peek()
        if kind == "name" and t.upper() in AGGREGATES and self.peek(1)[1] == "(":
            name = self.next()[1].upper()
            self.expect("(")
            distinct = bool(self.word("DISTINCT"))
            c = F.lit(1) if self.word("*") else self.expr()
            self.expect(")")
            if name == "COUNT":
                return (F.countDistinct(c) if distinct else F.count(c)), True
            if name in ("SUM", "AVG"):
                return (F.sum if name == "SUM" else F.avg)(c.cast("double")), True
            return (F.max if name == "MAX" else F.min)(c), True
        return self.expr(), False

    def expr(self) -> Column:
        c = self.conjunction()
        while self.word("||"):
            c = c | self.conjunction()
        return c

    def conjunction(self) -> Column:
        c = self.comparison()
        while self.word("&&"):
            c = c & self.comparison()
        return c

    def comparison(self) -> Column:
        number = self.peek()[0] == "num"
        a = self.primary()
        if self.word("NOT"):
            self.expect("IN")
            return ~a.isin(self.arguments_constant())
        if self.word("IN"):
            return a.isin(self.arguments_constant())
        if (op := self.word("=", "!=", "<", ">", "<=", ">=")) is None:
            return a
        number = number or self.peek()[0] == "num"
        b = self.primary()
        if number:
            a, b = a.try_cast("double"), b.try_cast("double")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def arguments_constant(self) -> list:
        self.expect("(")
        out = []
        while not self.word(")"):
            out.append(self.constant())
            self.word(",")
        return out

    def primary(self) -> Column:
        if self.word("("):
            c = self.expr()
            self.expect(")")
            return c
        if self.word("!"):
            return ~self.primary()
        kind, t = self.peek()
        if kind == "var":
            self.at += 1
            return F.col(t[1:])
        if kind == "name" and self.peek(1)[1] == "(":
            return self.call(self.next()[1].upper())
        return F.lit(self.constant())

    def call(self, name: str) -> Column:
        self.expect("(")
        if name == "LANG":
            kind, t = self.next()
            if kind != "var":
                raise ValueError("LANG takes a variable")
            self.expect(")")
            return F.coalesce(F.col(f"_lang_{t[1:]}"), F.lit(""))
        args: list[Column] = []
        while not self.word(")"):
            args.append(self.expr())
            self.word(",")
        if name in ("STR", "IRI", "URI"):
            return args[0].cast("string")
        if name == "LANGMATCHES":
            lang, wide = F.lower(args[0]), F.lower(args[1])
            return F.when(wide == "*", lang != "").otherwise((lang == wide) | F.startswith(lang, F.concat(wide, F.lit("-"))))
        simple = {
            "STRBEFORE": lambda c, x: F.when(F.contains(c, x), F.substr(c, F.lit(1), F.position(x, c) - 1)).otherwise(""),
            "STRAFTER": lambda c, x: F.when(F.contains(c, x), F.substr(c, F.position(x, c) + F.length(x))).otherwise(""),
            "SUBSTR": lambda c, at, n=None: F.substr(c, at.cast("int"), *([n.cast("int")] if n is not None else [])),
            "LCASE": F.lower, "UCASE": F.upper, "STRLEN": lambda c: F.length(c).cast("string"), "CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith,
            "CONCAT": F.concat, "COALESCE": F.coalesce, "BOUND": lambda c: c.isNotNull(), "ISBLANK": lambda c: c.startswith("_:"), "ISIRI": lambda c: c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"),
            "REGEX": lambda c, p, *f: F.regexp_like(c, F.concat(F.lit("(?i)") if f else F.lit(""), p)), "REPLACE": lambda c, p, r: F.regexp_replace(c, p, r), "IF": lambda c, a, b: F.when(c, a).otherwise(b),
        }
        if name not in simple:
            raise ValueError(f"function {name}")
        return simple[name](*args)
