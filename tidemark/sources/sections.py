"""Sections as directories of Parquet: contracts, scans, manifests, sealing, and what lies where.

A logical section is a directory; its layout versions are sub-directories layout=<type_id>, and each segment is a directory
segment_id=<id> below. Spark lists, prunes and reads them; a time filter reaches the row groups by their statistics, for
which files are written in the section's sort order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.frames import layout_union

CLASSES = ("timestamp", "label", "cumulative", "gauge")
SEMANTICS = ("changed", "conditional_full", "event_stream", "on_change", "snapshot_full")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    kind: str  # one of CLASSES
    nullable: bool = False
    gate: str | None = None  # section.column


@dataclass(frozen=True)
class Contract:
    """One layout version of a section."""

    type_id: int
    name: str
    semantics: str
    fields: tuple[Field, ...]
    sort_key: tuple[str, ...]
    identity: tuple[str, ...] = ()
    deprecated: bool = False

    def key(self) -> tuple[str, ...]:
        """The declared identity, else the sort key without time."""
        return self.identity or tuple(c for c in self.sort_key if c != "ts")

    def schema(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            out.add(f.name, T._parse_datatype_string(f.type), f.nullable, {"class": f.kind} | ({"gate": f.gate} if f.gate else {}))
        return out

    def of_class(self, kind: str) -> list[str]:
        return [f.name for f in self.fields if f.kind == kind]


def check_contract(c: Contract) -> list[str]:
    """What is wrong with a contract; nothing, if nothing."""
    names = [f.name for f in c.fields]
    out = [f"{c.name}: {n} comes twice" for n in {n for n in names if names.count(n) > 1}]
    out += [f"{c.name}: {n} isn't a column" for n in (*c.sort_key, *c.identity) if n not in names]
    out += [f"{c.name}.{f.name}: unknown class {f.kind}" for f in c.fields if f.kind not in CLASSES]
    out += [f"{c.name}.{f.name}: a gate is for counters" for f in c.fields if f.gate and f.kind != "cumulative"]
    if c.semantics not in SEMANTICS:
        out.append(f"{c.name}: unknown semantics {c.semantics}")
    if not any(f.kind == "timestamp" for f in c.fields):
        out.append(f"{c.name}: no time")
    return out


@dataclass
class Registry:
    contracts: list[Contract] = field(default_factory=list)

    def add(self, c: Contract) -> None:
        if wrong := check_contract(c):
            raise ValueError("; ".join(wrong))
        self.contracts.append(c)

    def versions(self, name: str) -> list[Contract]:
        return sorted((c for c in self.contracts if c.name == name), key=lambda c: c.type_id)

    def identity(self, name: str) -> tuple[str, ...]:
        """The union of all versions' identities: rows of a version without a later column are series of their own."""
        out: list[str] = []
        for c in self.versions(name):
            out += [k for k in c.key() if k not in out]
        return tuple(out)

    def listing(self, spark: SparkSession) -> DataFrame:
        """section, layouts, semantics, sort_key, columns."""
        rows = []
        for name in sorted({c.name for c in self.contracts}):
            vs = self.versions(name)
            columns = list(dict.fromkeys(f.name for v in vs for f in v.fields))
            rows.append((name, [v.type_id for v in vs], vs[-1].semantics, list(vs[-1].sort_key), columns))
        return spark.createDataFrame(rows, "section string, layouts array<bigint>, semantics string, sort_key array<string>, columns array<string>")


def scan(spark: SparkSession, root: str, registry: Registry, name: str) -> DataFrame:
    """All layouts of a logical section on the union of their columns."""
    return layout_union([spark.read.schema(T.StructType([*c.schema().fields, T.StructField("segment_id", T.LongType())])).parquet(f"{root}/{name}/layout={c.type_id}") for c in registry.versions(name)])


def write_part(df: DataFrame, root: str, contract: Contract, segment_id: int, mode: str = "append") -> None:
    """Rows of a segment, sorted within each file, zstd, with statistics. Null in a required column raises."""
    for f in contract.fields:
        if not f.nullable:
            df = df.withColumn(f.name, F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null in {contract.name}.{f.name}"))).otherwise(F.col(f.name)))
    df.select(*(f.name for f in contract.fields)).sortWithinPartitions(*contract.sort_key).write.mode(mode).option("compression", "zstd").parquet(f"{root}/{contract.name}/layout={contract.type_id}/segment_id={segment_id}")


def seal(spark: SparkSession, parts: str, root: str, contract: Contract, segment_id: int, files: int = 1) -> None:
    """Merges the live parts of a segment into few files in a total order, once: a sealed segment isn't written over."""
    df = spark.read.schema(contract.schema()).parquet(parts)
    rest = [f.name for f in contract.fields if f.name not in contract.sort_key]
    df = df.repartitionByRange(files, *contract.sort_key) if files > 1 else df.coalesce(1)
    df.sortWithinPartitions(*contract.sort_key, *rest).write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/{contract.name}/layout={contract.type_id}/segment_id={segment_id}")


def snapshot(sealed: DataFrame, live: DataFrame, key: str = "segment_id") -> DataFrame:
    """Sealed rows and those live rows whose segment isn't sealed."""
    return sealed.unionByName(live.join(sealed.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def manifest(df: DataFrame, section: str, ts: str = "ts", segment: str = "segment_id") -> DataFrame:
    """segment_id, section, min_ts, max_ts, rows."""
    return df.groupBy(segment).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count("*").alias("rows")).select(segment, F.lit(section).alias("section"), "min_ts", "max_ts", "rows")


def refresh(before: DataFrame, now: DataFrame, key: str = "segment_id", state: str = "state") -> DataFrame:
    """What changed between two listings: added, removed, promoted (live before, sealed now)."""
    both = before.select(key, F.col(state).alias("_a")).join(now.select(key, F.col(state).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when((F.col("_a") == "live") & (F.col("_b") == "sealed"), "promoted")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def dictionary_merge(parts: Sequence[DataFrame], key: str = "id", value: str = "value") -> DataFrame:
    """One row an id; an id with two values raises."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    merged = out.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    return merged.select(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("an id has two values"))).otherwise(F.col(value)).alias(value))


def resolve(df: DataFrame, column: str, dictionary: DataFrame, key: str = "id", value: str = "value", hot: int = 16) -> DataFrame:
    """The text of an id; 0 and unknown ids are null. The join is left, and salted so that a hot id isn't one task's."""
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(hot)).cast("int"))
    words = dictionary.select(F.col(key).alias(column), F.col(value).alias("_text")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(hot - 1))))
    return salted.join(words, [column, "_salt"], "left").withColumn(column, F.when(F.col(column) != 0, F.col("_text"))).drop("_text", "_salt").select(*df.columns)


def surrogate(text, limit: int = 1 << 20):
    """id (hash of the text; 0 is null) of a text cut to a limit."""
    return F.coalesce(F.xxhash64(F.substring(text, 1, limit)), F.lit(0))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, share of all bytes, of every file below a root, and its entry: what lies directly below the root, that file
    or the folder that holds it with the other parts of a table."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(top).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), "modificationTime")
    files = files.withColumn("entry", F.when(F.startswith("path", F.lit(f"{top}/")), F.substring_index(F.substring("path", len(top) + 2, 1 << 30), "/", 1)).otherwise(F.raise_error(F.concat(F.lit(f"not below {top}: "), "path"))))
    total = files.agg(F.sum("bytes").alias("_all"))
    return files.crossJoin(F.broadcast(total)).withColumn("share", F.col("bytes") / F.col("_all")).drop("_all")


def damaged(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows of the files that can be read; damaged ones are skipped, not fatal."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(root)


def orphans(sidecars: DataFrame, live: DataFrame, key: str, age: str, grace: int) -> DataFrame:
    """Derived files of segments that are gone, older than a grace."""
    return sidecars.join(live.select(key).distinct(), key, "left_anti").where(F.col(age) > grace)


def damage(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, damaged of the files below a root: whether one lacks the mark that a Parquet file begins and ends with."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    mark = F.lit(b"PAR1")
    whole = (F.col("length") >= 12) & (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    return files.select("path", F.col("length").alias("bytes"), (~whole).alias("damaged"))


def pinned(spark: SparkSession, root: str) -> list[str]:
    """The data files that are there now. A read of exactly these stays the same, whatever is written later."""
    return sorted(spark.read.option("recursiveFileLookup", "true").parquet(root).inputFiles())


def read_pinned(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> DataFrame:
    """The rows of pinned files; a file that has gone since raises."""
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
