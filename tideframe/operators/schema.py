"""Schema comparison: widening, change policies, contracts and drift."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# The family and the width of each type; a wider type of one family holds all values of a narrower one.
FAMILY = {
    "tinyint": "numeric", "smallint": "numeric", "int": "numeric", "bigint": "numeric", "decimal(38,0)": "numeric",
    "float": "float", "double": "float", "decimal": "float",
    "string": "string", "boolean": "boolean",
    "date": "temporal", "timestamp": "temporal", "timestamp_ntz": "temporal", "binary": "binary",
}
WIDTH = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "decimal(38,0)": 5, "float": 10, "double": 11, "decimal": 12, "string": 21}


class SchemaChangeError(ValueError):
    """The policy refuses the change; nothing has been written."""


def _name(kind: DataType | str) -> str:
    name = kind if isinstance(kind, str) else kind.simpleString()
    return "decimal" if name.startswith("decimal") and name != "decimal(38,0)" else name


def change_kind(old: DataType | str, new: DataType | str) -> str:
    """same, widened, narrowed or changed."""
    if (old if isinstance(old, str) else old.simpleString()) == (new if isinstance(new, str) else new.simpleString()):
        return "same"
    a, b = _name(old), _name(new)
    if a in WIDTH and b in WIDTH and FAMILY[a] == FAMILY[b] and WIDTH[a] != WIDTH[b]:
        return "widened" if WIDTH[b] > WIDTH[a] else "narrowed"
    return "changed"


@dataclass
class SchemaDiff:
    added: list[StructField] = field(default_factory=list)
    removed: list[StructField] = field(default_factory=list)
    retyped: list[tuple[StructField, StructField]] = field(default_factory=list)


def diff(target: StructType, staging: StructType) -> SchemaDiff:
    """What staging adds, lacks and types otherwise; names compare without case."""
    old, new = {f.name.lower(): f for f in target}, {f.name.lower(): f for f in staging}
    return SchemaDiff(
        [f for k, f in new.items() if k not in old],
        [f for k, f in old.items() if k not in new],
        [(old[k], f) for k, f in new.items() if k in old and old[k].dataType != f.dataType],
    )


def evolve(target: DataFrame, staging: DataFrame, policy: str = "append_new_columns", keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both frames with the same columns under the policy; a refused change raises first.

    ``append_new_columns`` adds columns and refuses removed or retyped ones;
    ``ignore`` writes the shared columns, in the target's types if that loses
    nothing; ``fail`` refuses any change; ``sync_all_columns`` takes staging's
    columns and types.
    """
    keys = [k.lower() for k in keys or []]
    d = diff(target.schema, staging.schema)
    names = lambda fields: ", ".join(f.name for f in fields)
    retyped = "; ".join(f"{a.name} from {a.dataType.simpleString()} to {b.dataType.simpleString()}" for a, b in d.retyped)
    if policy == "fail" and (d.added or d.removed or d.retyped):
        raise SchemaChangeError(f"schema changed: added [{names(d.added)}], removed [{names(d.removed)}], retyped [{retyped}]")
    if policy == "ignore":
        for old, new in d.retyped:
            if change_kind(new.dataType, old.dataType) != "widened":
                raise SchemaChangeError(f"{old.name}: {new.dataType.simpleString()} does not fit {old.dataType.simpleString()} without loss")
        gone = {f.name.lower() for f in d.removed}
        if gone & set(keys):
            raise SchemaChangeError(f"key columns missing: {', '.join(sorted(gone & set(keys)))}")
        held = [f for f in target.schema if f.name.lower() not in gone]
        lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in d.removed]
        rows = staging.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in held), *lacking)
        return target, rows.select(*target.columns)
    if policy == "sync_all_columns":
        if {f.name.lower() for f in d.removed} & set(keys):
            raise SchemaChangeError("a key column is missing from the query")
        have = {f.name.lower(): f.name for f in target.schema}
        rows = target.select(*((F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in staging.schema))
        return rows, staging
    if d.removed or d.retyped:
        raise SchemaChangeError(f"removed [{names(d.removed)}], retyped [{retyped}]")
    wider = target.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in d.added))
    return wider, staging.select(*wider.columns)


def contract(df: DataFrame, declared: dict[str, str], not_null: list[str] | None = None, strict: bool = False, on_widen: str = "warn") -> DataFrame:
    """(column_name, finding, severity, detail) where a table breaks its declared columns.

    Findings: missing, extra (strict only), widened (severity ``on_widen``),
    narrowed, changed, and null_values for declared not-null columns that hold
    nulls, which one aggregate over the data counts.
    """
    real = {f.name.lower(): f for f in df.schema}
    out = []
    for name, kind in declared.items():
        f = real.get(name.lower())
        if f is None:
            out.append((name, "missing", "error", kind))
            continue
        found = change_kind(kind, f.dataType)
        if found != "same" and not (found == "widened" and on_widen == "ignore"):
            out.append((name, found, on_widen if found == "widened" else "error", f"{kind} -> {f.dataType.simpleString()}"))
    if strict:
        known = {n.lower() for n in declared}
        out += [(f.name, "extra", "error", f.dataType.simpleString()) for f in df.schema if f.name.lower() not in known]
    checked = [c for c in not_null or [] if c.lower() in real]
    if checked:
        counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in checked)).first()
        out += [(c, "null_values", "error", str(counts[c])) for c in checked if counts[c]]
    return df.sparkSession.createDataFrame(out, "column_name string, finding string, severity string, detail string")


def drift(history: DataFrame) -> DataFrame:
    """Changes between consecutive schema versions of each table.

    ``history``: table_name, version (int), column_name, type, position, nullable.
    Returns table_name, version, column_name, change, severity, old_value,
    new_value. Removed columns pair with added ones of one family within two
    places as renames: in order of their places each takes the best that is left,
    the nearest, and by far one of equal type.
    """
    family = F.create_map(*(F.lit(x) for kv in FAMILY.items() for x in kv))
    width = F.create_map(*(F.lit(x) for kv in WIDTH.items() for x in kv))
    base = F.when(F.col("type").startswith("decimal") & (F.col("type") != "decimal(38,0)"), "decimal").otherwise(F.col("type"))
    h = history.withColumn("key", F.lower("column_name")).withColumn("family", F.coalesce(F.try_element_at(family, base), base)).withColumn("width", F.try_element_at(width, base))
    versions = h.select("table_name", "version").distinct()
    pairs = versions.alias("a").join(versions.alias("b"), (F.col("a.table_name") == F.col("b.table_name")) & (F.col("b.version") == F.col("a.version") + 1)).select(F.col("b.table_name").alias("table_name"), F.col("b.version").alias("version"))
    fields = ["column_name", "type", "position", "nullable", "family", "width"]
    side = lambda shift: pairs.join(h.withColumn("version", F.col("version") + shift), ["table_name", "version"]).select("table_name", "version", "key", F.struct(*fields).alias("f"))
    both = side(1).withColumnRenamed("f", "old").join(side(0).withColumnRenamed("f", "new"), ["table_name", "version", "key"], "full")
    gone, came = both.filter("new is null").select("table_name", "version", "old"), both.filter("old is null").select("table_name", "version", "new")
    near = gone.join(came, ["table_name", "version"]).filter("old.family = new.family and abs(old.position - new.position) <= 2")
    score = (10 - F.abs(F.col("old.position") - F.col("new.position")) + F.when(F.col("old.type") == F.col("new.type"), 5).otherwise(0)).alias("score")
    near = near.withColumn("score", score)
    # old columns in order take the best of the new ones that are left; a table has few of them
    order = F.sort_array(F.collect_list(F.struct(F.col("old.position").alias("at"), F.col("old.column_name").alias("o"), (-F.col("score")).alias("rank"), F.col("new.column_name").alias("n"))))
    taken = F.aggregate(
        "pairs", F.array().cast("array<struct<o:string,n:string>>"), lambda held, x: F.when(F.exists(held, lambda p: (p["o"] == x["o"]) | (p["n"] == x["n"])), held).otherwise(F.concat(held, F.array(F.struct(x["o"].alias("o"), x["n"].alias("n")))))
    )
    renamed = near.groupBy("table_name", "version").agg(order.alias("pairs")).select("table_name", "version", F.explode(taken).alias("p")).select("table_name", "version", "p.*")
    change = lambda df, kind, severity, name, old, new: df.select("table_name", "version", name.alias("column_name"), F.lit(kind).alias("change"), F.lit(severity).alias("severity"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    none, c = F.lit(None), F.col
    gone = gone.join(renamed.select("table_name", "version", c("o").alias("__o")), (c("__o") == c("old.column_name")) & (gone["table_name"] == renamed["table_name"]) & (gone["version"] == renamed["version"]), "left_anti")
    came = came.join(renamed.select("table_name", "version", c("n").alias("__n")), (c("__n") == c("new.column_name")) & (came["table_name"] == renamed["table_name"]) & (came["version"] == renamed["version"]), "left_anti")
    kept = both.filter("old is not null and new is not null")
    wide = kept.filter("old.type <> new.type").withColumn(
        "kind", F.when((c("old.family") == c("new.family")) & (c("new.width") > c("old.width")), "type_widened").when((c("old.family") == c("new.family")) & (c("new.width") < c("old.width")), "type_narrowed").otherwise("type_changed")
    )
    typed = wide.select("table_name", "version", c("key").alias("column_name"), c("kind").alias("change"), F.when(c("kind") == "type_widened", "info").when(c("kind") == "type_narrowed", "breaking").otherwise("warning").alias("severity"), c("old.type").alias("old_value"), c("new.type").alias("new_value"))
    return (
        change(renamed, "column_renamed", "breaking", c("o"), c("o"), c("n"))
        .union(change(gone, "column_removed", "breaking", F.lower("old.column_name"), c("old.type"), none))
        .union(change(came, "column_added", "info", F.lower("new.column_name"), none, c("new.type")))
        .union(typed)
        .union(change(kept.filter("old.nullable <> new.nullable"), "nullable_changed", "warning", c("key"), c("old.nullable"), c("new.nullable")))
        .union(change(kept.filter("old.position <> new.position"), "order_changed", "info", c("key"), c("old.position"), c("new.position")))
    )
