"""A fluent wrapper around one Spark DataFrame: immutable, lazy until an action, global in its results."""

from __future__ import annotations

import contextlib
import io
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut

JOINS = {"inner", "left", "right", "outer", "left_semi", "left_anti"}
#: Name of an aggregate function -> Spark function.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp,
    "std_pop": F.stddev_pop, "var": F.var_samp, "median": F.median, "first": F.first, "last": F.last, "nunique": F.count_distinct,
    "approx_nunique": F.approx_count_distinct,
}


def _names(columns: Iterable[str | Iterable[str]]) -> list[str]:
    out: list[str] = []
    for c in columns:
        out += [c] if isinstance(c, str) else list(c)
    return out


def missing(df: DataFrame, column: str, blank: bool = False) -> Column:
    """Null, NaN in a floating column, and with `blank` a blank string."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    out = c.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out = out | F.isnan(c)
    if blank and isinstance(kind, T.StringType):
        out = out | (F.trim(c) == "")
    return out


class Frame:
    """`Frame(df)`; every method that transforms returns a new Frame."""

    def __init__(self, df: DataFrame):
        if not isinstance(df, DataFrame):
            raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
        self.df = df

    # --- constructors and sinks ---

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: str | list[str], format: str | None = None, **options: Any) -> Frame:
        """Read one or more paths, each in its own or the forced format, and unite them by column name."""
        from millrace.sources.registry import read_paths

        return cls(read_paths(spark, paths, format, **options))

    @classmethod
    def from_dataset(cls, df: DataFrame) -> Frame:
        return cls(df)

    def write(self, path: str, format: str | None = None, **options: Any) -> None:
        from millrace.sources.writers import write

        write(self.df, path, format, **options)

    def to_parquet(self, path: str, **options: Any) -> None:
        self.write(path, "parquet", **options)

    def to_json(self, path: str, **options: Any) -> None:
        self.write(path, "json", **options)

    def to_csv(self, path: str, **options: Any) -> None:
        self.write(path, "csv", **options)

    def to_numpy(self, path: str, **options: Any) -> None:
        self.write(path, "numpy", **options)

    def to_tfrecords(self, path: str, **options: Any) -> None:
        self.write(path, "tfrecords", **options)

    def to_images(self, path: str, **options: Any) -> None:
        self.write(path, "images", **options)

    write_parquet, write_json, write_csv, write_numpy, write_tfrecords, write_images = to_parquet, to_json, to_csv, to_numpy, to_tfrecords, to_images

    def to_pipeline(self, output: str, **options: Any) -> Any:
        """A pipeline that starts from this frame's lazy plan; nothing is written in between."""
        from millrace.plans.pipeline import Pipeline

        return Pipeline.create(sources=[self], output=output, **options)

    # --- projections ---

    def select(self, *columns: str | list[str] | Column) -> Frame:
        if not columns:
            raise ValueError("select needs at least one column")
        flat = [x for c in columns for x in (c if isinstance(c, list) else [c])]
        return Frame(self.df.select(*flat))

    def drop(self, *columns: str | list[str]) -> Frame:
        return Frame(self.df.drop(*_names(columns)))

    drop_columns = drop

    def assign(self, **columns: Any) -> Frame:
        """Add columns: Columns, callables of this frame's DataFrame, or constants."""
        made = {k: v if isinstance(v, Column) else v(self.df) if callable(v) else F.lit(v) for k, v in columns.items()}
        return Frame(self.df.withColumns(made))

    def add_column(self, name: str, value: Any) -> Frame:
        return self.assign(**{name: value})

    def with_column(self, name: str, expr: Column | str | Callable[[dict], Any], returns: str | T.DataType | None = None) -> Frame:
        """Add a column from an expression or SQL text; a row callable runs as an Arrow batch function, its errors give null."""
        if isinstance(expr, Column):
            return Frame(self.df.withColumn(name, expr))
        if isinstance(expr, str):
            return Frame(self.df.withColumn(name, F.expr(expr)))

        def value(rows: pd.DataFrame) -> pd.Series:
            out = []
            for row in rows.to_dict("records"):
                try:
                    out.append(expr(row))
                except Exception:
                    out.append(None)
            return pd.Series(out, dtype=object)

        return Frame(self.df.withColumn(name, F.pandas_udf(value, returns or "string")(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]))))

    def rename(self, columns: Mapping[str, str]) -> Frame:
        return Frame(self.df.withColumnsRenamed(dict(columns)))

    # --- rows ---

    def filter(self, predicate: Column | str | Callable[[dict], bool] | None = None, *, expr: Column | str | None = None, fn: Callable[[dict], bool] | None = None) -> Frame:
        """Exactly one of `predicate`, `expr` and `fn`. Expressions reach the scan; a row callable runs on Arrow batches."""
        given = [x for x in (predicate, expr, fn) if x is not None]
        if len(given) != 1:
            raise ValueError("exactly one of predicate, expr and fn is needed")
        test = given[0]
        if isinstance(test, (Column, str)):
            return Frame(self.df.filter(test))

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield rows[[bool(test(r)) for r in rows.to_dict("records")]]

        return Frame(self.df.mapInPandas(keep, self.df.schema))

    where = filter

    def map(self, func: Callable[[dict], dict], schema: str | T.StructType | None = None, on_error: str = "skip") -> Frame:
        """Row to row; `schema` is taken from the first row's result if not given. Failing rows as in `flat_map`."""
        return self.flat_map(lambda row: [func(row)], schema, on_error)

    def flat_map(self, func: Callable[[dict], Iterable[dict] | dict], schema: str | T.StructType | None = None, on_error: str = "skip") -> Frame:
        """Row to any number of rows; a single dict counts as one.

        A row whose call fails is left out and counted in the result's `rejected.value` once an action has run (a repeated task
        counts again); a warning tells of the first of each batch. With on_error='raise' it fails the action.
        """
        if on_error not in ("skip", "raise"):
            raise ValueError("on_error must be skip or raise")
        wanted = self._schema(func, schema)
        rejected = self.df.sparkSession.sparkContext.accumulator(0)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out, lost, first = [], 0, None
                for row in rows.to_dict("records"):
                    try:
                        made = func(row)
                        out += [made] if isinstance(made, dict) else [dict(m) for m in made or ()]
                    except Exception as e:
                        if on_error == "raise":
                            raise
                        lost, first = lost + 1, first or e
                if lost:
                    rejected.add(lost)
                    warnings.warn(f"{lost} of {len(rows)} rows of a batch rejected, the first by {type(first).__name__}: {first}", stacklevel=2)
                yield pd.DataFrame(out, columns=wanted.names)

        made = Frame(self.df.mapInPandas(run, wanted))
        made.rejected = rejected
        return made

    def map_batches(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType | None = None, batch_size: int | None = None) -> Frame:
        """Pandas batch to pandas batch, at most `batch_size` rows each."""
        wanted = self._as_schema(schema) if schema else self.df.sparkSession.createDataFrame(func(self.df.limit(5).toPandas())).schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for at in range(0, len(rows), batch_size or max(1, len(rows))):
                    yield func(rows.iloc[at : at + batch_size] if batch_size else rows)

        return Frame(self.df.mapInPandas(run, wanted))

    def map_sql(self, query: str, table_name: str = "batch") -> Frame:
        """SQL over the whole frame, under `table_name`."""
        return Frame(self.df.sparkSession.sql(_named(query, table_name), frame=self.df))

    def _as_schema(self, schema: str | T.StructType) -> T.StructType:
        return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def _schema(self, func: Callable, schema: str | T.StructType | None) -> T.StructType:
        if schema is not None:
            return self._as_schema(schema)
        for row in self.df.limit(1).collect():
            try:
                made = func(row.asDict(True))
            except Exception as e:
                raise ValueError(f"no schema given, and the call fails for the first row: {type(e).__name__}: {e}") from e
            made = [made] if isinstance(made, dict) else list(made)
            if made:
                return self.df.sparkSession.createDataFrame([Row(**made[0])]).schema
        return self.df.schema

    # --- joins and set operations ---

    def join(self, other: Frame, on: str | list[str], how: str = "inner", right_on: str | list[str] | None = None, null_equal: bool = False) -> Frame:
        """Equi-join; key columns come once. With `right_on` the keys have other names on the right and are dropped there.

        Nulls match nothing unless `null_equal`. Other columns in both get the suffixes _x and _y.
        """
        if how not in JOINS:
            raise ValueError(f"how must be one of {sorted(JOINS)}")
        left_on = _names([on])
        names = _names([right_on]) if right_on is not None else left_on
        right = other.df.withColumnsRenamed(dict(zip(names, left_on)))
        left = self.df
        if how not in ("left_semi", "left_anti"):
            both = (set(left.columns) & set(right.columns)) - set(left_on)
            left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
            right = right.withColumnsRenamed({c: f"{c}_y" for c in both})
        if not null_equal:
            return Frame(left.join(right, left_on, how))
        marked = right.withColumnsRenamed({k: f"_right_{k}" for k in left_on})
        cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"_right_{k}"]) for k in left_on])
        out = left.join(marked, cond, how)
        if how in ("left_semi", "left_anti"):
            return Frame(out)
        if how in ("right", "outer"):
            out = out.withColumns({k: F.coalesce(k, f"_right_{k}") for k in left_on})
        return Frame(out.drop(*[f"_right_{k}" for k in left_on]))

    def union(self, *others: Frame) -> Frame:
        """All rows of all frames, by column name; missing columns are null."""
        return Frame(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o.df for o in others], self.df))

    def concat(self, others: list[Frame], axis: int = 0, order_by: str | list[str] | None = None) -> Frame:
        """axis 0: union. axis 1: side by side, rows paired by their place in `order_by` order."""
        if axis == 0:
            return self.union(*others)
        if order_by is None:
            raise ValueError("axis 1 needs order_by: rows have no order of their own")

        def placed(f: Frame) -> DataFrame:
            from millrace.operators.order import with_row_index

            return with_row_index(f.df, _names([order_by]), "_row")

        out = placed(self)
        for o in others:
            right = placed(o)
            right = right.drop(*[c for c in right.columns if c in out.columns and c != "_row"])
            out = out.join(right, "_row", "outer")
        return Frame(out.drop("_row"))

    def distinct(self, *columns: str | list[str]) -> Frame:
        """One row a key, or distinct whole rows (map columns are compared as JSON)."""
        names = _names(columns)
        maps = [f.name for f in self.df.schema if isinstance(f.dataType, (T.MapType, T.VariantType))]
        if names or not maps:
            return Frame(self.df.dropDuplicates(names) if names else self.df.distinct())
        keyed = self.df.withColumns({f"_key_{c}": F.to_json(c) for c in maps})
        return Frame(keyed.dropDuplicates([c for c in keyed.columns if c not in maps]).select(*self.df.columns))

    def drop_duplicates(self, subset: str | list[str] | None = None, keep: str | bool = "first", order_by: str | list[str] | None = None) -> Frame:
        """Keep the first or last row of each key in `order_by` order (any row without it), or with keep=False only keys with one row."""
        names = _names([subset]) if subset else list(self.df.columns)
        if keep is not False and order_by is None:
            return Frame(self.df.dropDuplicates(names))
        # aggregates with map-side combining: a key of any size costs one row a task
        row = F.struct(*self.df.columns).alias("_row")
        if keep is False:
            out = self.df.groupBy(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.first(row).alias("_row"), F.count("*").alias("_n")).filter("_n = 1")
        else:
            # nulls count as last
            order = F.struct(*[x for c in _names([order_by]) for x in (F.col(c).isNull(), F.col(c))])
            pick = F.min_by if keep == "first" else F.max_by
            out = self.df.groupBy(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(pick(row, order).alias("_row"))
        return Frame(out.select("_row.*"))

    def dropna(self, subset: str | list[str] | None = None) -> Frame:
        """Rows without a null, NaN or blank string in `subset` (all columns; unknown names are ignored)."""
        names = [c for c in (_names([subset]) if subset else self.df.columns) if c in self.df.columns]
        return Frame(reduce(lambda d, c: d.filter(~missing(self.df, c, blank=True)), names, self.df))

    def fillna(self, value: Any, subset: str | list[str] | None = None) -> Frame:
        """Replace null and NaN by `value` (or by column from a dict) in columns of a type that can hold it."""
        wanted = value if isinstance(value, dict) else {c: value for c in (_names([subset]) if subset else self.df.columns)}
        return Frame(self.df.withColumns({c: F.when(missing(self.df, c), F.lit(v)).otherwise(F.col(c)) for c, v in wanted.items() if c in self.df.columns and _holds(self.df.schema[c].dataType, v)}))

    def fill_direction(self, method: str, order_by: str | list[str], columns: str | list[str] | None = None, partition_by: str | list[str] | None = None, split_hot: bool | None = None) -> Frame:
        """ffill/pad takes the last known value before, bfill/backfill the next after, in `order_by` order.

        With `split_hot` partitions are spread over tasks; without a word it is done where one (or, without partitions, the table) has
        more rows than `operators.order.HOT`.
        """
        from millrace.operators.order import has_hot, running

        if method not in ("ffill", "pad", "bfill", "backfill"):
            raise ValueError(f"unknown method {method}")
        forward = method in ("ffill", "pad")
        w = Window.partitionBy(*_names([partition_by] if partition_by else [])).orderBy(*_names([order_by]))
        w = w.rowsBetween(Window.unboundedPreceding, 0) if forward else w.rowsBetween(0, Window.unboundedFollowing)
        names = _names([columns]) if columns else [c for c in self.df.columns if c not in _names([order_by])]
        known = {c: F.when(~missing(self.df, c), F.col(c)) for c in names}
        if split_hot is None:
            split_hot = has_hot(self.df, _names([partition_by] if partition_by else []))
        if split_hot:
            clean = self.df.withColumns(known)
            filled = running(clean, _names([partition_by] if partition_by else []), _names([order_by]), {f"_f_{c}": ("last_known", c) for c in names}, backward=not forward)
            return Frame(filled.select(*[F.col(f"_f_{c}").alias(c) if c in names else F.col(c) for c in self.df.columns]))
        return Frame(self.df.withColumns({c: (F.last(v, ignorenulls=True) if forward else F.first(v, ignorenulls=True)).over(w) for c, v in known.items()}))

    # --- grouping, windows ---

    def groupby(self, *keys: str | list[str]) -> Grouped:
        if not keys:
            raise ValueError("groupby needs at least one key")
        return Grouped(self.df, _names(keys))

    def window(self, partition_by: str | list[str] | None = None, order_by: str | list[str] | None = None) -> Windowed:
        return Windowed(self.df, _names([partition_by] if partition_by else []), _names([order_by] if order_by else []))

    def pivot(self, index: str | list[str], columns: str, values: str, fn: str = "mean", known: list | None = None) -> Frame:
        """One row for each index, one column for each value of `columns`; `known` names them and saves a pass."""
        return Frame(self.df.groupBy(*_names([index])).pivot(columns, known).agg(AGGREGATES[fn](values)))

    def aggregate(self, **columns: Column) -> Frame:
        return Frame(self.df.agg(*[c.alias(k) for k, c in columns.items()]))

    def _scalar(self, c: Column) -> Any:
        return self.df.agg(c.alias("x")).first()["x"]

    def max(self, column: str) -> Any:
        return self._scalar(F.max(column))

    def min(self, column: str) -> Any:
        return self._scalar(F.min(column))

    def mean(self, column: str) -> Any:
        return self._scalar(F.avg(column))

    def sum(self, column: str) -> Any:
        return self._scalar(F.sum(column))

    def std(self, column: str, ddof: int = 1) -> Any:
        return self._scalar(F.stddev_samp(column) if ddof else F.stddev_pop(column))

    # --- order, sampling, partitioning ---

    def sort(self, by: str | list[str], ascending: bool | list[bool] = True) -> Frame:
        """Nulls come last in either direction."""
        names = _names([by])
        ups = [ascending] * len(names) if isinstance(ascending, bool) else ascending
        if len(ups) != len(names):
            raise ValueError("ascending must be one flag or one a column")
        return Frame(self.df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(names, ups)]))

    def limit(self, n: int) -> Frame:
        if n <= 0:
            raise ValueError("n must be positive")
        return Frame(self.df.limit(n))

    def sample(self, fraction: float | None = None, n: int | None = None, seed: int | None = None) -> Frame:
        if (fraction is None) == (n is None):
            raise ValueError("exactly one of fraction and n is needed")
        if fraction is not None:
            if not 0 <= fraction <= 1:
                raise ValueError("fraction must be in [0, 1]")
            return Frame(self.df.sample(fraction=fraction, seed=seed))
        return Frame(self.df.orderBy(F.rand(seed)).limit(n))

    def repartition(self, num_partitions: int) -> Frame:
        if num_partitions <= 0:
            raise ValueError("num_partitions must be positive")
        return Frame(self.df.repartition(num_partitions))

    def coalesce(self, num_partitions: int) -> Frame:
        if num_partitions <= 0:
            raise ValueError("num_partitions must be positive")
        return Frame(self.df.coalesce(num_partitions))

    def repartition_by_hash(self, columns: str | list[str], num_partitions: int | None = None) -> Frame:
        names = _names([columns])
        return Frame(self.df.repartition(num_partitions, *names) if num_partitions else self.df.repartition(*names))

    def cache(self, storage_level: str = "memory") -> Frame:
        levels = {"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY, "gpu": StorageLevel.MEMORY_AND_DISK}
        return Frame(self.df.persist(levels[storage_level]))

    def persist(self, **_: Any) -> Frame:
        return self.cache()

    def materialize(self) -> Frame:
        out = self.cache()
        out.df.count()
        return out

    def checkpoint(self, path: str | None = None, format: str = "parquet") -> Frame:
        """Write the frame and go on from what was written."""
        if path is None:
            return Frame(cut(self.df, "frame"))
        self.df.write.mode("overwrite").format(format).save(path)
        return Frame(self.df.sparkSession.read.format(format).schema(self.df.schema).load(path))

    # --- actions and protocol ---

    def collect(self) -> list[dict]:
        return [r.asDict(True) for r in self.df.collect()]

    def take(self, n: int) -> list[dict]:
        if n <= 0:
            raise ValueError("n must be positive")
        return [r.asDict(True) for r in self.df.take(n)]

    def head(self, n: int = 10) -> list[dict]:
        return self.take(n)

    def tail(self, n: int = 10) -> list[dict]:
        return [r.asDict(True) for r in self.df.tail(n)]

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 20) -> None:
        self.df.show(n)

    def explain(self) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.df.explain("formatted")
        return out.getvalue()

    def stats(self) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.df.explain("cost")
        return out.getvalue()

    def to_dataset(self) -> DataFrame:
        return self.df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def copy(self) -> Frame:
        return Frame(self.df)

    def __len__(self) -> int:
        return self.count()

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(True) for r in self.df.toLocalIterator(prefetchPartitions=True))

    def __contains__(self, value: Any) -> bool:
        """A dict: whether a row has all its values. Anything else: whether a cell of a fitting type equals it."""
        if isinstance(value, dict):
            if not set(value) <= set(self.df.columns):
                return False
            tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in value.items()]
            return not self.df.filter(reduce(lambda a, b: a & b, tests, F.lit(True))).limit(1).isEmpty()
        tests = [F.col(f.name) == F.lit(value) for f in self.df.schema if _holds(f.dataType, value)]
        return bool(tests) and not self.df.filter(reduce(lambda a, b: a | b, tests)).limit(1).isEmpty()

    def __getitem__(self, key: str | int | slice | list[str]) -> Any:
        """Column name: its values; place: that row; slice: those rows; list of names: a Frame."""
        if isinstance(key, str):
            return [r[0] for r in self.df.select(key).collect()]
        if isinstance(key, list):
            return self.select(*key)
        if isinstance(key, int):
            rows = self.df.offset(key).limit(1).collect() if key >= 0 else self.df.tail(-key)[:1]
            if not rows:
                raise IndexError(key)
            return rows[0].asDict(True)
        start, stop, step = key.indices(self.count()) if (key.start or 0) < 0 or (key.stop or 0) < 0 or key.stop is None else (key.start or 0, key.stop, key.step or 1)
        rows = [r.asDict(True) for r in self.df.offset(start).limit(max(0, stop - start)).collect()]
        return rows[::step]

    def __getattr__(self, name: str) -> Any:
        if not name.startswith("_") and "df" in self.__dict__ and name in self.df.columns:
            return self[name]
        raise AttributeError(name)

    def __add__(self, other: Frame) -> Frame:
        return self.union(other) if isinstance(other, Frame) else NotImplemented

    def __or__(self, other: Frame) -> Frame:
        """Union of all rows, duplicates kept."""
        return self + other

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{n} {t}' for n, t in self.df.dtypes)})"


def _named(query: str, table: str) -> str:
    """The query with the table's name as a parameter, braces kept."""
    import re

    return re.sub(rf"\b{re.escape(table)}\b", "{frame}", query.replace("{", "{{").replace("}", "}}"))


def _holds(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, T.NumericType)
    if isinstance(value, float):
        return isinstance(kind, (T.FractionalType,))
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


class Grouped:
    """Groups of a frame; every method is one shuffle with map-side combining."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, keys

    def agg(self, aggregations: Mapping[str, str | list[str]]) -> Frame:
        """{column: function or functions}; results are named function(column)."""
        made = [AGGREGATES[fn](c).alias(f"{fn}({c})") for c, fns in aggregations.items() for fn in ([fns] if isinstance(fns, str) else fns)]
        return Frame(self.df.groupBy(*self.keys).agg(*made))

    aggregate = agg

    def count(self) -> Frame:
        return Frame(self.df.groupBy(*self.keys).agg(F.count("*").alias("count()")))

    def _each(self, fn: str, columns: tuple[str, ...]) -> Frame:
        names = _names(columns) or [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType) and f.name not in self.keys]
        return self.agg({c: fn for c in names})

    def sum(self, *columns: str) -> Frame:
        return self._each("sum", columns)

    def mean(self, *columns: str) -> Frame:
        return self._each("mean", columns)

    def max(self, *columns: str) -> Frame:
        return self._each("max", columns)

    def min(self, *columns: str) -> Frame:
        return self._each("min", columns)

    def _edge(self, order_by: str | list[str] | None, pick: Callable) -> Frame:
        rest = [c for c in self.df.columns if c not in self.keys]
        by = F.struct(*_names([order_by])) if order_by else F.struct(*self.df.columns)
        out = self.df.groupBy(*self.keys).agg(pick(F.struct(*rest), by).alias("_row"))
        return Frame(out.select(*self.keys, "_row.*").select(*self.df.columns))

    def first(self, order_by: str | list[str] | None = None) -> Frame:
        """The first row of each group in `order_by` order (of all columns if not given), without sorting the groups."""
        return self._edge(order_by, F.min_by)

    def last(self, order_by: str | list[str] | None = None) -> Frame:
        return self._edge(order_by, F.max_by)

    def apply(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> Frame:
        """A pandas function of each group."""
        return Frame(self.df.groupBy(*self.keys).applyInPandas(func, schema))


class Windowed:
    """Window functions over partitions of a frame."""

    def __init__(self, df: DataFrame, partition_by: list[str], order_by: list[str]):
        self.df, self.partition_by, self.order_by = df, partition_by, order_by

    @property
    def _ordered(self) -> Any:
        w = Window.partitionBy(*self.partition_by)
        return w.orderBy(*(self.order_by or self.df.columns))

    def row_number(self, name: str = "row_number") -> Frame:
        return Frame(self.df.withColumn(name, F.row_number().over(self._ordered)))

    add_row_number = row_number

    def rank(self, name: str = "rank") -> Frame:
        return Frame(self.df.withColumn(name, F.rank().over(self._ordered)))

    def dense_rank(self, name: str = "dense_rank") -> Frame:
        return Frame(self.df.withColumn(name, F.dense_rank().over(self._ordered)))

    def ntile(self, n: int, name: str = "ntile") -> Frame:
        return Frame(self.df.withColumn(name, F.ntile(n).over(self._ordered)))

    def lag(self, column: str, offset: int = 1, name: str | None = None) -> Frame:
        return Frame(self.df.withColumn(name or f"{column}_lag", F.lag(column, offset).over(self._ordered)))

    def lead(self, column: str, offset: int = 1, name: str | None = None) -> Frame:
        return Frame(self.df.withColumn(name or f"{column}_lead", F.lead(column, offset).over(self._ordered)))

    def over(self, column: str, fn: str, rows: tuple[int, int] | None = None) -> Frame:
        """`column`_`fn` over the whole partition, or over a frame of `rows` before and after."""
        if fn in ("rank", "row_number", "dense_rank"):
            w = Window.partitionBy(*self.partition_by).orderBy(*(self.order_by or [column]))
            return Frame(self.df.withColumn(f"{column}_{fn}", getattr(F, fn)().over(w)))
        w = Window.partitionBy(*self.partition_by)
        if rows:
            w = self._ordered.rowsBetween(*rows)
        return Frame(self.df.withColumn(f"{column}_{fn}", AGGREGATES[fn](column).over(w)))


def read(spark: SparkSession, paths: str | list[str], **options: Any) -> Frame:
    return Frame.from_paths(spark, paths, **options)
