"""Providers of landed files as a Spark data source, with the capabilities that each of them really has.

`register(spark)` makes the format `landed` known:

    spark.read.format("landed").options(provider="star", capability="trades", root=folder).load().where("l_quantity > 30")

A provider is described, not programmed: which capabilities it has, in which files each lies, with what columns, label and
flags. Asking for anything else raises NotProvided; nothing is made up. Files are Parquet or CSV with a header in any store
that Arrow reads by its URI. A partition is one row group (a CSV file whole); filters on whole numbers, text, booleans, dates and
timestamps are pushed down: they skip row groups by statistics and are applied to batches before Spark sees them, the rest Spark
applies itself. A schema given by the user reads only its columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from .store import FLAGS, LABELS

#: What a provider may be able to give.
CAPABILITIES = (
    "daily_bars", "intraday_bars", "corporate_actions", "earnings_events", "earnings_estimates", "fundamentals", "short_interest", "option_quotes_eod", "macro_series",
    "index_membership", "classifications", "security_master", "trades", "ticks")


KINDS = {
    "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "float": FloatType(), "string": StringType(), "boolean": BooleanType(), "date": DateType(),
    "timestamp": TimestampType(), "timestamp_ntz": TimestampNTZType()}


class NotProvided(NotImplementedError):
    """A capability that the provider does not have."""


@dataclass(frozen=True)
class Landed:
    """Where a capability's files lie under the root (a file or a folder of files), and its columns as DDL."""

    path: str
    schema: str

    def typed(self) -> StructType:
        """The columns; parsed here, as workers have no session that could."""
        return StructType([StructField(name, KINDS[kind]) for name, kind in (c.split() for c in self.schema.split(", "))])


@dataclass(frozen=True)
class Provider:
    name: str
    label: str
    gives: dict[str, Landed]
    flags: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        unknown = (set(self.gives) - set(CAPABILITIES)) | (set(self.flags) - set(FLAGS)) | ({self.label} - set(LABELS))
        if unknown:
            raise ValueError(f"{self.name}: unknown {sorted(unknown)}")

    def capabilities(self) -> list[str]:
        return [c for c in CAPABILITIES if c in self.gives]

    def landed(self, capability: str) -> Landed:
        if capability not in self.gives:
            raise NotProvided(f"{self.name} does not provide {capability}; it provides {', '.join(self.capabilities())}")
        return self.gives[capability]


#: Providers by name; `add` puts more here.
PROVIDERS: dict[str, Provider] = {}


def add(provider: Provider) -> Provider:
    PROVIDERS[provider.name] = provider
    return provider


#: The given star schema: line items as trades, events as ticks, orders as releases.
add(Provider("star", "SIMULATED", {
    "trades": Landed("lineitem.parquet", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "ticks": Landed("events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
}))


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


class LandedSource(DataSource):
    """The format `landed`: options provider, capability and root."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def _landed(self) -> Landed:
        return provider(self.options["provider"]).landed(self.options["capability"])

    def schema(self) -> StructType:
        return self._landed().typed()

    def reader(self, schema: StructType) -> DataSourceReader:
        found = self._landed()
        known = {f.name: f.dataType for f in found.typed().fields}
        strange = [f.name for f in schema.fields if known.get(f.name) != f.dataType]
        if strange:
            raise ValueError(f"columns that {self.options['provider']} does not have so: {strange}")
        return LandedReader(f"{self.options['root'].rstrip('/')}/{found.path}", schema)


@dataclass
class Group(InputPartition):
    """A row group of a Parquet file, or a whole CSV file (-1)."""

    path: str
    group: int

    def __hash__(self) -> int:
        return hash((self.path, self.group))


_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class LandedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.arrow, self.pushed = path, [f.name for f in schema.fields], to_arrow_schema(schema), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what Arrow decides exactly as Spark does. Floating point stays with Spark, which orders NaN above all."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = self.arrow.field(name).type if name in self.columns else None
            if kind is not None and not pa.types.is_floating(kind) and isinstance(f, (*_COMPARED, In, IsNotNull, IsNull, StringStartsWith)):
                self.pushed.append(f)
            else:
                yield f

    def _files(self) -> tuple[pyarrow.fs.FileSystem, list[str]]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        found = store.get_file_info(path)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == pyarrow.fs.FileType.File:
            return store, [path]
        inside = store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        return store, sorted(i.path for i in inside if i.is_file and i.base_name.endswith((".parquet", ".csv")))

    def _may_hold(self, group: pq.RowGroupMetaData) -> bool:
        """False if statistics show that no row passes."""
        by_name = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for f in self.pushed:
            s = by_name.get(f.attribute[0])
            if s is None or not s.has_min_max or not isinstance(f, (*_COMPARED, In)):
                continue
            for value in [f.value] if isinstance(f, tuple(_COMPARED)) else [None]:
                outside = {
                    EqualTo: lambda v: v < s.min or v > s.max, GreaterThan: lambda v: s.max <= v, GreaterThanOrEqual: lambda v: s.max < v,
                    LessThan: lambda v: s.min >= v, LessThanOrEqual: lambda v: s.min > v, In: lambda v: all(x < s.min or x > s.max for x in f.value if x is not None)}[type(f)]
                if outside(value):
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, files = self._files()
        out = []
        for path in files:
            if path.endswith(".csv"):
                out.append(Group(path, -1))
                continue
            with store.open_input_file(path) as source:
                meta = pq.ParquetFile(source).metadata
                out += [Group(path, g) for g in range(meta.num_row_groups) if self._may_hold(meta.row_group(g))]
        return out or [Group("", -2)]

    def _passes(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = None
        for f in self.pushed:
            column = batch.column(self.columns.index(f.attribute[0]))
            if isinstance(f, IsNotNull):
                one = pc.is_valid(column)
            elif isinstance(f, IsNull):
                one = pc.is_null(column)
            elif isinstance(f, In):
                one = pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
                one = pc.and_(one, pc.is_valid(column))
            elif isinstance(f, StringStartsWith):
                one = pc.starts_with(column, f.value)
            else:
                one = _COMPARED[type(f)](column, pa.scalar(f.value, column.type))
            keep = one if keep is None else pc.and_kleene(keep, one)
        return batch if keep is None else batch.filter(keep)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition.group == -2:
            return
        store = pyarrow.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pyarrow.fs.LocalFileSystem()
        with store.open_input_file(partition.path) as source:
            if partition.group == -1:
                options = pyarrow.csv.ConvertOptions(include_columns=self.columns, column_types={f.name: f.type for f in self.arrow}, strings_can_be_null=True)
                batches = pyarrow.csv.open_csv(source, convert_options=options)
            else:
                batches = pq.ParquetFile(source).iter_batches(row_groups=[partition.group], columns=self.columns)
            for batch in batches:
                typed = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in self.arrow], schema=self.arrow)
                yield self._passes(typed)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)
