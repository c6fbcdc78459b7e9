"""Masks and row policies, applied where a table is read, so that all that follows sees governed rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.masks import mask
from tideframe.operators.closure import propagate

# Masks from the strongest to the weakest.
STRENGTH = ["null", "redact", "hash", "consistent_hash", "credit_card", "partial", "email", "phone", "first_initial", "ip_address", "truncate", "range", "date_shift", "noise"]


@dataclass(frozen=True)
class Mask:
    """A column's mask; roles in ``exempt`` see the value, and rows where ``condition`` is not true do."""

    column: str
    method: str
    config: dict[str, Any] = field(default_factory=dict)
    exempt: tuple[str, ...] = ("admin",)
    condition: str | None = None


@dataclass(frozen=True)
class Viewer:
    user: str
    role: str
    attributes: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RowPolicy:
    """A filter in SQL for the roles and users named (all if none is), but for those exempt.

    user(), role(), attr('x') and attr_list('x') stand for the viewer's.
    """

    filter: str
    roles: tuple[str, ...] = ()
    users: tuple[str, ...] = ()
    exempt_roles: tuple[str, ...] = ("admin",)
    exempt_users: tuple[str, ...] = ()
    enabled: bool = True

    def applies(self, viewer: Viewer) -> bool:
        """Whether the policy restricts the viewer."""
        if not self.enabled or viewer.role in self.exempt_roles or viewer.user in self.exempt_users:
            return False
        return not (self.roles or self.users) or viewer.role in self.roles or viewer.user in self.users


def apply_masks(df: DataFrame, masks: list[Mask], role: str) -> DataFrame:
    """The frame with its columns masked for a role; conditions see the values before any mask."""
    by = {m.column.lower(): m for m in masks if role not in m.exempt}
    out = []
    for c in df.columns:
        m = by.get(c.lower())
        if m is None:
            out.append(F.col(f"`{c}`"))
            continue
        hidden = mask(F.col(f"`{c}`"), m.method, m.config)
        # a value that stays next to masked ones has to be of their type
        out.append((F.when(F.expr(m.condition), hidden).otherwise(F.col(f"`{c}`").cast(df.select(hidden.alias("x")).schema["x"].dataType)) if m.condition else hidden).alias(c))
    return df.select(*out)


_CALL = re.compile(r"\b(user|role|attr|attr_list)\(\s*(?:'([^']*)')?\s*\)")


def apply_row_policies(df: DataFrame, policies: list[RowPolicy], viewer: Viewer) -> DataFrame:
    """Rows that all policies that apply to the viewer let pass.

    The viewer's values are bound as literals, never put into the SQL text.
    Attributes are found whatever their case. One that is not set is null, and
    so is a list read by attr; attr_list has text, a single value being a list of
    one. A call without a name makes its filter false.
    """
    held_attributes = {str(k).lower(): v for k, v in viewer.attributes.items()}
    for p in policies:
        if not p.applies(viewer):
            continue
        bound: dict[str, Any] = {}
        bad = False

        def literal(m: re.Match, bound=bound) -> str:
            nonlocal bad
            kind, name = m.group(1), m.group(2)
            if kind in ("attr", "attr_list") and not name:
                bad = True
                return "NULL"
            value = viewer.user if kind == "user" else viewer.role if kind == "role" else held_attributes.get(name.lower())
            if kind == "attr_list":
                items = list(value) if isinstance(value, (list, tuple)) else [] if value is None else [value]
                value = F.array(*(F.lit(str(v)) for v in items)) if items else F.array().cast("array<string>")
            elif isinstance(value, (list, tuple)):
                value = None
            key = f"p{len(bound)}"
            bound[key] = value if kind == "attr_list" else F.lit(value)
            return f"__viewer.{key}"

        text = _CALL.sub(literal, p.filter)
        if bad:
            return df.filter(F.lit(False))
        if bound:
            held = df.withColumn("__viewer", F.struct(*(v.alias(k) for k, v in bound.items())))
            df = held.filter(F.expr(text)).drop("__viewer")
        else:
            df = df.filter(F.expr(text))
    return df


def governed(df: DataFrame, viewer: Viewer, policies: list[RowPolicy] | None = None, masks: list[Mask] | None = None) -> DataFrame:
    """Rows first, by their true values, then masks."""
    return apply_masks(apply_row_policies(df, policies or [], viewer), masks or [], viewer.role)


_BITS = 63


def strongest_mask(edges: DataFrame, masks: DataFrame, declassified: DataFrame | None = None) -> DataFrame:
    """(derived, method, exempt) of every column without a mask of its own that derives, in however many steps, from masked ones.

    It takes the strongest mask that reaches it, and only roles exempt from all
    of them stay exempt. A mask of its own goes before what a column would
    inherit, and is what its own derivations inherit; ``declassified`` columns
    (node) inherit nothing and pass nothing on. ``edges``: derived, source;
    ``masks``: source, method, exempt (array). Roles, which are few, go through
    the driver to become bits.
    """
    roles = sorted(r[0] for r in masks.select(F.explode("exempt").alias("r")).filter("r is not null").distinct().collect())
    parts = [roles[i : i + _BITS] for i in range(0, len(roles), _BITS)]
    bits = lambda part: sum((F.when(F.array_contains(F.col("exempt"), r), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(part)), F.lit(0).cast("long"))
    rank = F.array_position(F.array(*(F.lit(m) for m in STRENGTH)), F.col("method"))
    known = masks.select(F.col("source").alias("node"), F.struct(rank.alias("rank"), "method").alias("strongest"), *(bits(p).alias(f"roles{i}") for i, p in enumerate(parts)))
    stop = known.select("node") if declassified is None else known.select("node").union(declassified.select("node"))
    combine = {"strongest": F.min, **{f"roles{i}": F.bit_and for i in range(len(parts))}}
    reached = propagate(edges, known, combine, stop)
    exempt = F.concat(F.array().cast("array<string>"), *(F.array_compact(F.array(*(F.when(F.getbit(F.col(f"roles{i}"), F.lit(k)) == 1, F.lit(r)) for k, r in enumerate(p)))) for i, p in enumerate(parts)))
    own = masks.select(F.col("source").alias("node")).distinct()
    return reached.join(own.hint("merge"), "node", "left_anti").select(F.col("node").alias("derived"), F.col("strongest.method").alias("method"), F.sort_array(exempt).alias("exempt"))


def inherited_classes(edges: DataFrame, classified: DataFrame, declassified: DataFrame | None = None) -> DataFrame:
    """(node, class) of every column that is classified (node, class) or derives from one that is; of several classes the first by name.

    A class of its own goes before what a column would inherit; ``declassified`` columns (node) inherit nothing.
    """
    stop = classified.select("node") if declassified is None else classified.select("node").union(declassified.select("node"))
    return propagate(edges, classified.select("node", "class"), {"class": F.min}, stop)


def pii_report(classified: DataFrame, masks: DataFrame) -> DataFrame:
    """Classified columns (table_name, column_name, class) without a mask (table_name, column_name)."""
    return classified.join(masks, ["table_name", "column_name"], "left_anti")
