"""The engine: query texts to DataFrames and files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from skein.catalog import Catalog, Declared
from skein.errors import AnalysisProblem
from skein.functions.registry import Registry
from skein.lang import ast as A
from skein.lang.parser import parse
from skein.plans.inline import inline
from skein.plans.lower import Lowering
from skein.sources.sinks import write_text
from skein.types import DECIMAL, read_schema_file


@dataclass(frozen=True)
class Settings:
    """What a host, a properties file or "declare option" sets; names have - or _ alike."""

    output_dir: str = ""
    delete_existing: bool = False
    delimiter: str = "|"
    strict: bool = False  # an unknown field of a record type is an error, not empty
    range_partitions: int | None = None  # of a range that for runs over; Spark's default if not set
    broadcast_threshold: int | None = None  # bytes up to which Spark may broadcast a side of a join
    shuffle_partitions: int | None = None

    def with_options(self, options: dict[str, str]) -> Settings:
        known = {f.name: f for f in fields(self)}
        found = {}
        for key, text in options.items():
            name = key.rpartition(":")[2].replace("-", "_")
            if name not in known:
                raise AnalysisProblem(f"unknown option {key}; there are {', '.join(known)}")
            kind = str(known[name].type)
            found[name] = text.strip().lower() in ("true", "yes", "1") if kind == "bool" else int(text) if kind.startswith("int") else text
        return replace(self, **found)

    @classmethod
    def from_file(cls, path: str) -> Settings:
        """Lines of key = value; # begins a comment."""
        with open(path, encoding="utf-8") as lines:
            pairs = [line.split("#")[0].partition("=") for line in lines]
        return cls().with_options({k.strip(): v.strip() for k, eq, v in pairs if eq})


class Engine:
    """Runs queries over declared collections.

    >>> Engine(spark).query("for $i in 1 to 3 return $i * 2").collect()
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.catalog, self.functions = Catalog(), Registry()

    def declare(self, name: str, format: str, location: str, schema: T.StructType | None = None, **options: str) -> None:
        self.catalog.declare(name, Declared(format, location, schema, options))

    def declare_frame(self, name: str, df: DataFrame) -> None:
        self.catalog.declare(name, df)

    def register(self, name: str, build: Callable[..., Column], least: int, most: int | None = None) -> None:
        """A function of queries: build makes a Column from the arguments' Columns."""
        self.functions.add(name, build, least, most)

    def query(self, text: str) -> DataFrame:
        """The result of a query text, not yet computed."""
        return self.lower(parse(text))

    def lower(self, module: A.Module | A.Node) -> DataFrame:
        if not isinstance(module, A.Module):
            module = A.Module((), (), (), (), module)
        settings = self.settings.with_options(dict(module.options))
        catalog = self.catalog.copy()
        for i in module.imports:
            catalog.declare_types(i.prefix, read_schema_file(self.spark, i.location, DECIMAL))
        for c in module.collections:
            notes = dict(c.annotations)
            if "location" not in notes:
                raise AnalysisProblem(f"collection {c.name} has no %location")
            schema = catalog.type(c.type) if c.type else None
            options = {k: v for k, v in notes.items() if k not in ("format", "location")}
            catalog.declare(c.name, Declared(notes.get("format", "csv"), notes["location"], schema, options))
        confs = {"spark.sql.autoBroadcastJoinThreshold": settings.broadcast_threshold, "spark.sql.shuffle.partitions": settings.shuffle_partitions}
        spark = self.spark
        if any(value is not None for value in confs.values()):
            # A session of its own, like this one but for what the query sets: it holds until the lazy plan runs, and for no other query.
            spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
            for key, value in confs.items():
                if value is not None:
                    spark.conf.set(key, str(value))
        return Lowering(spark, catalog, self.functions, settings.strict, settings.range_partitions).query(inline(module))

    def run(self, text: str, name: str = "result") -> str:
        """Writes a query's result as text into <output_dir>/<name> and returns that folder."""
        module = parse(text)
        settings = self.settings.with_options(dict(module.options))
        location = f"{settings.output_dir.rstrip('/')}/{name}" if settings.output_dir else name
        write_text(self.lower(module), location, settings.delimiter, settings.delete_existing)
        return location

    def explain(self, text: str) -> str:
        """The physical plan of a query."""
        return self.query(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
