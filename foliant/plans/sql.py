"""Declarative plans as chains of common table expressions, in Spark SQL or DuckDB's dialect.

An operator adds named steps to a Plan and returns the name of its result. ``Plan.frame`` hands the whole chain
to Catalyst over DataFrames; ``Plan.text`` renders the same relational plan for another engine, which is how
results are cross-checked. What the two dialects spell differently lives in the Dialect classes.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    name = "spark"

    @staticmethod
    def lit(s: str) -> str:
        """A string literal, taken raw."""
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"

    def pct(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def half_even(self, x: str, n: int) -> str:
        """As DuckDB's round_even: of the product in doubles, which bround's decimals tell from a tie in other places."""
        return f"(rint(({x}) * 1e{n}) / 1e{n})"

    def mean(self, x: str) -> str:
        """The mean of doubles, the same in any order of rows: an exact sum to 20 digits unless values are huge or not numbers."""
        return f"CASE WHEN min({x}) >= -1e12 AND max({x}) <= 1e12 THEN CAST(sum(try_cast({x} AS DECIMAL(38, 20))) / count({x}) AS DOUBLE) ELSE avg({x}) END"

    def spread(self, x: str) -> str:
        """The population deviation of whole numbers, the same in any order of rows: from exact sums."""
        whole = f"CAST({x} AS DECIMAL(19, 0))"
        return f"(sqrt(CAST(CAST(count({x}) AS DECIMAL(38, 0)) * CAST(sum({whole} * {whole}) AS DECIMAL(38, 0)) - CAST(sum({whole}) AS DECIMAL(38, 0)) * CAST(sum({whole}) AS DECIMAL(38, 0)) AS DOUBLE)) / count({x}))"

    def pmod(self, x: str, n: str) -> str:
        return f"pmod({x}, {n})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit(pattern)})"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def one(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def gaps(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)}, -1)"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.lit(''.join(chr(92) + c if c in '.|*+?()[]{}^$' + chr(92) else c for c in by))}, -1)"

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n', -1)"

    def each(self, source: str, array: str) -> str:
        """FROM clause: a row (pos, val) for each element, pos from 0."""
        return f"{source} LATERAL VIEW posexplode({array}) e AS pos, val"

    def text_agg(self, x: str, by: str, sep: str = ",") -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {by})"

    def list_agg(self, x: str, by: str) -> str:
        return f"transform(sort_array(collect_list(struct({by} AS k, {x} AS v))), s -> s.v)"

    def at(self, a: str, i: str) -> str:
        """Element i, from 1; null beyond the end."""
        return f"try_element_at({a}, {i})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def keep(self, a: str, test: str) -> str:
        return f"filter({a}, x -> {test})"

    def each_of(self, a: str, to: str) -> str:
        return f"transform({a}, x -> {to})"

    def find(self, text: str, part: str) -> str:
        return f"instr({text}, {part})"

    def long(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def parsed(self, x: str, kind: str) -> str:
        return f"try_cast({x} AS {kind})"

    def numbers(self, n: int) -> str:
        return f"(SELECT id FROM range(0, {n}))"

    def epoch(self, x: str) -> str:
        return f"unix_seconds(CAST({x} AS TIMESTAMP))"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pct(self, x, q):
        return f"quantile_cont({x}, {q})"

    def half_even(self, x, n):
        return f"round_even({x}, {n})"

    def mean(self, x):
        return f"avg({x})"

    def spread(self, x):
        return f"stddev_pop({x})"

    def pmod(self, x, n):
        return f"((({x}) % ({n})) + ({n})) % ({n})"

    def idiv(self, a, b):
        return f"(({a}) // ({b}))"

    def sha(self, x):
        return f"sha256({x})"

    def like(self, x, pattern):
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def gaps(self, x, pattern):
        return f"regexp_split_to_array({x}, {self.lit(pattern)})"

    def split(self, x, by):
        return f"string_split({x}, {self.lit(by)})"

    def lines(self, x):
        return f"string_split({x}, chr(10))"

    def each(self, source, array):
        return f"{source} CROSS JOIN LATERAL (SELECT unnest({array}) AS val, generate_subscripts({array}, 1) - 1 AS pos) e"

    def text_agg(self, x, by, sep=","):
        return f"string_agg({x}, '{sep}' ORDER BY {by})"

    def list_agg(self, x, by):
        return f"list({x} ORDER BY {by})"

    def at(self, a, i):
        return f"({a})[{i}]"

    def size(self, a):
        return f"len({a})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def keep(self, a, test):
        return f"list_filter({a}, lambda x: {test})"

    def each_of(self, a, to):
        return f"list_transform({a}, lambda x: {to})"

    def find(self, text, part):
        return f"strpos({text}, {part})"

    def numbers(self, n):
        return f"(SELECT range AS id FROM range(0, {n}))"

    def epoch(self, x):
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def json(self, x, path):
        return f"json_extract_string({x}, '$.{path}')"


SPARK, DUCK = Spark(), Duck()


class Plan:
    """Named steps over input tables."""

    def __init__(self, dialect: Spark = SPARK):
        self.d, self.steps, self.recursive = dialect, [], False

    def add(self, name: str, sql: str) -> str:
        """Add a step; its name gets a number, so that an operator can be used twice."""
        own = f"{name}_{len(self.steps)}"
        self.steps.append((own, sql))
        return own

    def text(self, result: str, columns: str = "*", inputs: tuple[tuple[str, str], ...] = ()) -> str:
        steps = [*inputs, *self.steps]
        chain = ",\n".join(f"{n} AS {self._once(n)}({s})" for n, s in steps)
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{chain}\nSELECT {columns} FROM {result}" if steps else f"SELECT {columns} FROM {result}"

    def _once(self, name: str) -> str:
        """DuckDB plans a step anew for each step that reads it; one that several read is computed once."""
        if self.d.name == "spark" or self.recursive:
            return ""
        readers = sum(len(re.findall(rf"\b{re.escape(name)}\b", s)) for _, s in self.steps)
        return "MATERIALIZED " if readers > 1 else ""

    def frame(self, spark: SparkSession, result: str, columns: str = "*", **tables: DataFrame) -> DataFrame:
        """The result over DataFrames that the steps name. The session's own views stay as they are."""
        views = {name: f"foliant_{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        try:
            return spark.sql(self.text(result, columns, tuple((n, f"SELECT * FROM {v}") for n, v in views.items())))
        finally:
            for v in views.values():  # the text is analysed by now
                spark.catalog.dropTempView(v)


def as_frame(build: Callable) -> Callable:
    """Turn ``build(plan, source, ...)`` into a function on DataFrames."""

    @functools.wraps(build)
    def on(df: DataFrame, *args, **kwargs) -> DataFrame:
        plan = Plan(SPARK)
        return plan.frame(df.sparkSession, build(plan, "src", *args, **kwargs), src=df)

    return on


class Query:
    """A registered query: its Spark form over a folder of tables, and the same plan for DuckDB."""

    def __init__(self, name: str, tables: tuple[str, ...], build: Callable[[Plan], tuple[str, str]]):
        self.name, self.tables, self.build = name, tables, build

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan(SPARK)
        result, columns = self.build(plan)
        return plan.frame(spark, result, columns, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})

    def oracle(self) -> str:
        plan = Plan(DUCK)
        result, columns = self.build(plan)
        return plan.text(result, columns)
