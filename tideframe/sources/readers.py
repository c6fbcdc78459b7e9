"""Reading: files, object stores, databases, paged JSON, and incremental syncs of them."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tideframe.operators.keys import checksum_columns, table_checksum
from tideframe.sources.files import exists, settled


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """With a header; types are inferred unless a schema is given, which repeated loads should do."""
    reader = spark.read.option("header", True).options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json(spark: SparkSession, path: str, schema: StructType | str | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Parquet or JSON by the end of the path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return parquet(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return json(spark, path, multiline=kind == "json")
    if kind in ("csv", "tsv"):
        return csv(spark, path, sep="\t" if kind == "tsv" else ",")
    raise ValueError(f"no reader for .{kind}")


def external(spark: SparkSession, format: str, path: str | None = None, **options: Any) -> DataFrame:
    """Any Spark source by format name: object stores by URL, warehouses by their connectors."""
    reader = spark.read.format(format).options(**options)
    return reader.load(path) if path else reader.load()


def jdbc(spark: SparkSession, url: str, dbtable: str, partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 1, **options: Any) -> DataFrame:
    """A database table; with a partition column and its bounds the read is split into that many queries. The driver's jar is the user's."""
    return spark.read.format("jdbc").options(**jdbc_options(url, dbtable, partition_column, bounds, partitions), **options).load()


def jdbc_by_quantiles(spark: SparkSession, url: str, dbtable: str, column: str, partitions: int, **options: Any) -> DataFrame:
    """A database table read in parts of about as many rows each, whatever the distribution of a numeric ``column``.

    Bounds are quantiles of the column, which is read alone for that, rather than
    equal steps between its ends, which a skewed key would leave all but empty.
    Rows where the column is null are a part of their own; every row is in one part.
    """
    quoted = column if column.startswith('"') else f'"{column}"'
    keys = spark.read.format("jdbc").options(url=url, query=f"SELECT {quoted} FROM {dbtable}", **options).load()
    shares = F.array(*(F.lit(k / partitions) for k in range(1, partitions)))
    found = keys.agg(F.percentile_approx(keys.columns[0], shares, 10_000)).first()[0] if partitions > 1 else []
    cuts = sorted(set(found or []))
    if not cuts:
        predicates = [f"{quoted} IS NOT NULL"]
    else:
        inner = [f"{quoted} >= {a} AND {quoted} < {b}" for a, b in zip(cuts, cuts[1:])]
        predicates = [f"{quoted} < {cuts[0]}", *inner, f"{quoted} >= {cuts[-1]}"]
    properties = {k: str(v) for k, v in options.items()}
    return spark.read.jdbc(url, dbtable, predicates=[*predicates, f"{quoted} IS NULL"], properties=properties)


def jdbc_options(url: str, dbtable: str, partition_column: str | None, bounds: tuple[Any, Any] | None, partitions: int) -> dict[str, str]:
    out = {"url": url, "dbtable": dbtable}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        out |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def sync_high_watermark(source: DataFrame, target: DataFrame | None, column: str, mark: Any = None) -> tuple[DataFrame, Any]:
    """(target with the rows of source above the mark, new mark); no mark takes all. The mark is a literal, so the source gets the filter."""
    fresh = source if mark is None else source.filter(F.col(column) > F.lit(mark).cast(source.schema[column].dataType))
    top = fresh.agg(F.max(column)).first()[0]
    return (fresh if target is None else target.unionByName(fresh, allowMissingColumns=True)), (mark if top is None else top)


def changed_files(spark: SparkSession, path: str, format: str = "parquet", since: Any = None, **options: Any) -> tuple[DataFrame, Any]:
    """(rows of files modified after ``since``, newest modification time)."""
    df = spark.read.format(format).options(**options).load(path)
    at = F.col("_metadata.file_modification_time")
    df = df.select("*", at.alias("__at"))
    if since is not None:
        df = df.filter(F.col("__at") > F.lit(since))
    newest = df.agg(F.max("__at")).first()[0]
    return df.drop("__at"), (since if newest is None else newest)


#: What is known of a folder's files: where, how large, when changed, the checksum of the rows, and when it was looked at.
FILE_STATE = "path string, bytes long, modified_at timestamp, rows long, hash_sum decimal(38,0), hash_xor long, checked_at timestamp"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified_at of every file of a folder and those below; nothing is read. Files of no bytes count as not there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def file_changes(spark: SparkSession, path: str, state: DataFrame | None, format: str, schema: StructType | str, now: datetime, verify: bool = False, grain_seconds: int = 2, **options: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of added and replaced files with ``_file``, changes, new state) since ``state`` (FILE_STATE, None at first).

    changes: path, change (added, replaced, touched, deleted). Files are held
    against the state one by one, so those of one instant, replaced ones and
    deleted ones are all told. A file of another size or time is read, and counts
    as replaced if the checksum of its rows differs, as touched if not; so is one
    that was changed within ``grain_seconds`` of the last look, as a later change
    of it could bear the same time. ``verify`` reads all. Checksums are aggregates
    of rows by file, so a file of any size is split among tasks. Frames are tables
    of the work folder.
    """
    known = state if state is not None else spark.createDataFrame([], FILE_STATE)
    there = settled(listed(spark, path))
    old = known.select("path", F.struct(*(c for c in known.columns if c != "path")).alias("old"))
    both = there.join(old, "path", "left")
    unclear = F.unix_timestamp("old.modified_at") >= F.unix_timestamp("old.checked_at") - grain_seconds
    same = (F.col("bytes") == F.col("old.bytes")) & (F.col("modified_at") == F.col("old.modified_at")) & ~unclear & ~F.lit(verify)
    suspect = settled(both.filter(~F.coalesce(same, F.lit(False))))
    names = [r["path"] for r in suspect.select("path").collect()]  # Spark plans the read of these files on the driver
    if names:
        rows = spark.read.format(format).schema(schema).options(**options).load(names)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
    else:
        rows = spark.createDataFrame([], spark.createDataFrame([], schema).schema.add("_file", "string"))
    sums = rows.groupBy(F.col("_file").alias("path")).agg(*checksum_columns(rows.drop("_file")))
    empty = {"rows": F.lit(0).cast("long"), "hash_sum": F.lit(None).cast("decimal(38,0)"), "hash_xor": F.lit(None).cast("long")}
    read = suspect.join(sums, "path", "left").select("path", "bytes", "modified_at", F.coalesce("rows", empty["rows"]).alias("rows"), F.coalesce("hash_sum", empty["hash_sum"]).alias("hash_sum"), F.coalesce("hash_xor", empty["hash_xor"]).alias("hash_xor"), "old")
    equal = (F.col("rows") == F.col("old.rows")) & F.col("hash_sum").eqNullSafe(F.col("old.hash_sum")) & F.col("hash_xor").eqNullSafe(F.col("old.hash_xor"))
    moved = (F.col("bytes") != F.col("old.bytes")) | (F.col("modified_at") != F.col("old.modified_at"))
    kind = F.when(F.col("old").isNull(), "added").when(~equal, "replaced").when(moved, "touched")
    judged = settled(read.withColumn("change", kind))
    gone = known.join(there, "path", "left_anti").select("path", F.lit("deleted").alias("change"))
    changes = judged.filter("change is not null").select("path", "change").unionByName(gone)
    fresh = rows.join(judged.filter("change in ('added', 'replaced')").select(F.col("path").alias("_file")), "_file", "left_semi").select(*rows.columns)
    at = F.lit(now).cast("timestamp").alias("checked_at")
    names_ = [c.split()[0] for c in FILE_STATE.split(", ")]
    checked = judged.select("path", "bytes", "modified_at", "rows", "hash_sum", "hash_xor", at)
    kept = known.join(there.select("path"), "path", "left_semi").join(judged.select("path"), "path", "left_anti").select(*names_)
    return fresh, changes, kept.unionByName(checked)


def apply_file_changes(target: DataFrame | None, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The target (rows with ``_file``) without those of deleted and replaced files, and with the fresh ones."""
    if target is None:
        return fresh
    gone = changes.filter("change in ('deleted', 'replaced', 'added')").select(F.col("path").alias("_file"))
    return target.join(gone, "_file", "left_anti").select(*target.columns).unionByName(fresh)


def content_hash(spark: SparkSession, path: str) -> str:
    """Checksum of the lines of all files of a path, whatever their order and size; the driver sees one value."""
    return "/".join(str(x) for x in table_checksum(spark.read.text(path)).first())


def load_seed(spark: SparkSession, path: str, known_hash: str | None = None) -> tuple[DataFrame | None, str]:
    """(rows, content hash) of a CSV file, rows None if the hash is known; an empty file is a table with the column empty_file."""
    digest = content_hash(spark, path)
    if digest == known_hash:
        return None, digest
    if spark.read.text(path).isEmpty():
        return spark.createDataFrame([], "empty_file boolean"), digest
    return csv(spark, path), digest


def paged_json(pages: DataFrame, schema: StructType | str, rows_path: str = "$", lift: str | None = None, column: str = "value") -> DataFrame:
    """Records of raw pages, one JSON document a row: parse, walk the dotted path to the array of rows (``$`` is the root), explode, lift a nested struct."""
    parsed = pages.select(F.from_json(column, schema).alias("page"))
    items = F.col("page") if rows_path == "$" else F.col(f"page.{rows_path.removeprefix('$.')}")
    kind = parsed.select(items.alias("x")).schema["x"].dataType
    rows = parsed.select(F.explode(items).alias("r")) if isinstance(kind, ArrayType) else parsed.select(items.alias("r"))
    flat = rows.filter("r is not null").select("r.*")
    if lift and lift in flat.columns:
        flat = flat.select(*(c for c in flat.columns if c != lift), f"{lift}.*")
    return flat


def poll_watermark(rows: DataFrame, column: str, mark: str | None = None) -> str | None:
    """Largest value as text, the old mark if there are no rows."""
    top = rows.agg(F.max(F.col(column).cast("string"))).first()[0]
    return mark if top is None else top


def flatten_inbox(inbox: DataFrame, schema: StructType | str) -> DataFrame:
    """A typed table from an inbox (id, received_at, payload as JSON)."""
    return inbox.select("id", "received_at", F.from_json("payload", schema).alias("p")).select("id", "received_at", "p.*")


def infer_payload(inbox: DataFrame, sample: int = 100) -> str:
    """Schema of the payloads, merged over a sample; for a first look, not for repeated loads."""
    texts = [r[0] for r in inbox.filter("payload is not null").select("payload").limit(sample).collect()]
    array = inbox.sparkSession.range(1).select(F.schema_of_json(F.lit("[" + ",".join(texts) + "]"))).first()[0]
    return array.removeprefix("ARRAY<").removesuffix(">")


def table_or_base(spark: SparkSession, path: str, base: str) -> DataFrame:
    """A table of this environment, or of the base environment where it has not been built."""
    return parquet(spark, path if exists(spark, path) else base)
