"""Versioned, write-once Parquet tables with manifests, and SQL over named versions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import SCHEMAS, duplicates

LABELS = ("REAL", "DERIVED", "SIMULATED")
#: What may be wrong with a data set.
FLAGS = ("SURVIVORSHIP_RISK", "NO_PIT_MEMBERSHIP", "VENDOR_ADJUSTED", "PARTIAL_VOLUME", "MODEL_PRICED", "REVISABLE_NO_VINTAGE", "UNVERIFIED_SOURCE", "SURVIVORSHIP_BIASED_UNIVERSE")
MANIFEST = "table string, content_hash string, n_rows bigint, label string, flags array<string>, forced boolean, problems array<string>, at string"


class DataProblem(ValueError):
    """A data set that fails its checks and was not forced."""


def derive_label(labels: list[str]) -> str:
    """SIMULATED absorbs; everything else that is derived is DERIVED."""
    return "SIMULATED" if "SIMULATED" in labels else "DERIVED"


def content_hash(df: DataFrame) -> str:
    """A hash of schema and rows that does not depend on their order: count and two sums of row hashes."""
    columns = sorted(df.columns)
    row = F.struct(*columns)
    big = lambda *x: F.coalesce(F.sum(F.xxhash64(*x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    a = df.select(row.alias("r")).agg(F.count(F.lit(1)).alias("n"), big("r").alias("a"), big(F.lit(1), F.col("r")).alias("b"))
    kinds = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return a.select(F.sha2(F.concat_ws("|", F.lit(kinds), "n", "a", "b"), 256)).first()[0]


class Store:
    """Tables under a root that driver and executors share: <root>/<table>/version=<hash>, manifests in <root>/_manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, df: DataFrame, label: str = "REAL", flags: tuple[str, ...] = (), force: bool = False) -> str:
        """Checks, writes once, appends a manifest; equal content is written only once. Returns the content hash."""
        schema = SCHEMAS.get(name)
        problems = schema.problems(df) if schema else []
        if schema and not problems and duplicates(df, list(schema.key)).first()[0]:
            problems = [f"duplicate key {schema.key}"]
        if problems and not force:
            raise DataProblem(f"{name}: {'; '.join(problems)}")
        digest = content_hash(df)
        if not self.versions(name).where(F.col("content_hash") == digest).limit(1).count():
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}/version={digest}")
        at = datetime.now(UTC).isoformat()
        row = [(name, digest, self.spark.read.parquet(f"{self.root}/{name}/version={digest}").count(), label, list(flags), bool(problems), problems, at)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/_manifests")
        return digest

    def versions(self, name: str | None = None) -> DataFrame:
        try:
            m = self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifests")
            m.limit(1).count()
        except Exception as e:  # nothing has been saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            m = self.spark.createDataFrame([], MANIFEST)
        return m if name is None else m.where(F.col("table") == name)

    def latest(self, name: str) -> str:
        row = self.versions(name).agg(F.max_by("content_hash", "at")).first()
        if row[0] is None:
            raise KeyError(name)
        return row[0]

    def load(self, name: str, digest: str | None = None) -> DataFrame:
        """A version, checked against its hash."""
        digest = digest or self.latest(name)
        df = self.spark.read.parquet(f"{self.root}/{name}/version={digest}")
        if content_hash(df) != digest:
            raise DataProblem(f"{name}@{digest[:12]} has changed")
        return df

    def query(self, sql: str, **tables: str) -> DataFrame:
        """SQL over views given as view='table' or 'table@hash'."""
        for view, ref in tables.items():
            name, _, digest = ref.partition("@")
            self.load(name, digest or None).createOrReplaceTempView(view)
        return self.spark.sql(sql)

    def forced_errors(self) -> DataFrame:
        """table, content_hash, problem of data saved by force."""
        return self.versions().where("forced").select("table", "content_hash", F.explode("problems").alias("problem"))


class Artifacts:
    """Write-once tables of experiments under a shared root, known by a reference: path, content hash, rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, experiment: str, name: str, df: DataFrame) -> dict:
        """The reference under which the table is found again; a name that is taken is an error."""
        path = f"{experiment}/{name}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{path}")
        kept = self.spark.read.parquet(f"{self.root}/{path}")
        return {"path": path, "hash": content_hash(kept), "rows": kept.count()}

    def load(self, ref: dict) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{ref['path']}")
        if content_hash(df) != ref["hash"]:
            raise DataProblem(f"artifact {ref['path']} has changed")
        return df
