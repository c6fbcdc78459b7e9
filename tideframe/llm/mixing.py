"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic) on Spark; the cell weights
are raked until the weighted tokens match the target shares of every source,
language and topic; documents are then drawn independently, each with its cell's
weight times a constant that makes the expected tokens meet the budget, one at
most. Every source and language is a level of its own. Only where ``max_levels``
is given do the rarer ones that no target names share one more, which aims at the
sum of what they would have had.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideframe.llm.graph import keep
from tideframe.llm.wordhash import NOT_SPACE, texts, word_hashes

OTHER, MISSING = "\x00other", "\x00null"
LONG_WORD = 6
#: Cells that are broadcast at most.
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Targets:
    """Shares by level for each dimension, or the power of the data's own shares to aim at.

    Power 1 keeps a dimension's shares, 0 makes them equal; levels without a
    share get none of the mass, levels without tokens are passed over.
    """

    source: Mapping[str, float] | float = 0.5
    lang: Mapping[str, float] | float = 0.7
    topic: Mapping[str, float] | float = 0.0


def profile(docs: DataFrame, columns: list[str], topics: int = 8) -> DataFrame:
    """``columns`` of every row, with __tokens (words between white space) and __topic.

    The text is ``__text`` or the field ``text`` of a column ``row``. A word of six
    bytes or more belongs to one of ``topics`` classes by its hash; a text's topic
    is the class of most of its such words, the smallest on ties and 0 for texts
    without any (null and empty ones included).
    """
    inner = "row" in columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, topic = [], []
            for lo, hi, data, offs in texts(batch.column("row").field("text") if inner else batch.column("__text")):
                words, first, starts, ends = word_hashes(data, offs, NOT_SPACE)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                long = ends - starts >= LONG_WORD
                votes = np.bincount(doc[long] * topics + (words[long] % np.uint64(topics)).astype(np.int64), minlength=(hi - lo) * topics)
                tokens.append(np.diff(first))
                topic.append(votes.reshape(hi - lo, topics).argmax(axis=1))
            both = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (tokens, topic)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *both], [*columns, "__tokens", "__topic"])

    rows = docs.select(*columns) if inner else docs.select(*columns, F.col("text").cast("string").alias("__text"))
    kinds = StructType([f for f in rows.schema.fields if f.name in columns])
    return rows.mapInArrow(measure, kinds.add("__tokens", "long").add("__topic", "long"))


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Weights w >= 0 of cells so that each marginal of cells * w has the target shares; its total is kept.

    ``codes[d]`` has each cell's level of dimension d, ``targets[d]`` the shares by
    level. Where targets contradict the empty cells, the last round stands.
    """
    weight = np.ones(len(cells))
    total = cells.sum()
    if total <= 0:
        return weight
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, cells * weight, len(target))
            aim = np.where(now > 0, target, 0)
            aim = aim / aim.sum() * total if aim.sum() > 0 else now
            factor = np.divide(aim, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(np.where(now > 0, factor - 1, 0)).max()))
            weight *= factor[code]
        if worst < tolerance:
            break
    return weight


def calibrate(cells: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) whose expected tokens are the budget, or all there are to have."""
    able = (weight > 0) & (cells > 0)
    if budget <= 0 or not able.any():
        return np.zeros(len(cells))
    if budget >= cells[able].sum():
        return (weight > 0).astype(float)
    low, high = 0.0, 1 / weight[able].min()
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (np.minimum(1, c * weight) * cells).sum() < budget else (low, c)
    return np.minimum(1, high * weight)


def _level(column: str, named: list[str] | None) -> Column:
    name = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    if named is None:
        return name
    return F.when(name.isin(named), name).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def _plan(rows: DataFrame, targets: Targets, rate: float, max_levels: int | None) -> tuple[list[Column], DataFrame]:
    """The level columns and the cell table with weight and probability."""
    spark = rows.sparkSession
    columns, merged = [], {}
    for c, target in (("source", targets.source), ("lang", targets.lang)):
        kept = None
        if max_levels is not None:
            name = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            sums = rows.groupBy(name.alias("level")).agg(F.sum("__tokens").alias("n"))
            kept = [r[0] for r in sums.orderBy(F.desc("n"), "level").limit(max_levels).collect()]
            if isinstance(target, Mapping):
                kept = sorted({*kept, *target})
            else:
                rest = sums.filter("n > 0").filter(~F.col("level").isin(kept)) if kept else sums.filter("n > 0")
                merged[f"__{c}"] = rest.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(float(target))))).first()[0] or 0.0
        columns.append(_level(c, kept).alias(f"__{c}"))
    columns.append(F.col("__topic").cast("string").alias("__topic_level"))
    names = ["__source", "__lang", "__topic_level"]
    found = rows.groupBy(*columns).agg(F.sum("__tokens").cast("double").alias("n")).orderBy(*names).collect()
    cells = np.array([r["n"] or 0 for r in found], float)
    codes, aims = [], []
    for name, target in zip(names, (targets.source, targets.lang, targets.topic), strict=True):
        levels = sorted({r[name] for r in found})
        at = {x: i for i, x in enumerate(levels)}
        code = np.array([at[r[name]] for r in found], int)
        if isinstance(target, Mapping):
            aim = np.array([target.get(x, 0.0) for x in levels], float)
        else:
            mass = np.bincount(code, cells, len(levels)) if len(code) else np.zeros(0)
            aim = np.where(mass > 0, mass, 0) ** target * (mass > 0)
            if name in merged and OTHER in at:
                aim[at[OTHER]] = merged[name]
        codes.append(code)
        aims.append(aim)
    weight = rake(cells, codes, aims)
    chance = calibrate(cells, weight, rate * cells.sum())
    # a table of more cells than tasks should hold is joined
    small = F.broadcast if len(found) <= BROADCAST_CELLS else (lambda df: df)
    table = spark.createDataFrame(
        [(*(r[n] for n in names), float(w), float(p)) for r, w, p in zip(found, weight, chance, strict=True)],
        "__source string, __lang string, __topic_level string, __weight double, __probability double",
    )
    return columns, small(table)


def _draw(seed: int) -> Column:
    """Uniform in [0, 1) by doc_id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/mix"), F.col("doc_id").cast("long"), "__crc"), 11)
    return bits / F.lit(float(1 << 53))


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("__crc")


def _sampled(rows: DataFrame, columns: list[Column], table: DataFrame, seed: int) -> DataFrame:
    named = rows.select("*", *columns)
    return named.join(table, ["__source", "__lang", "__topic_level"], "left").withColumn("__sampled", _draw(seed) < F.col("__probability"))


def mix(docs: DataFrame, targets: Targets = Targets(), rate: float = 0.5, topics: int = 8, max_levels: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled for every row of ``docs``.

    ``weight`` is the raked weight of a token of the document, ``probability``
    the chance to be drawn so that about ``rate`` of all tokens are, ``sampled``
    the draw, which depends on doc_id and text alone. Null sources and languages
    are levels of their own. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = keep(profile(docs.select("doc_id", "source", "lang", "text", _crc()), ["doc_id", "source", "lang", "__crc"], topics))
    columns, table = _plan(rows, targets, rate, max_levels)
    return _sampled(rows, columns, table, seed).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.col("__topic").cast("int").alias("topic"),
        F.col("__tokens").alias("tokens"),
        F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"),
        F.col("__sampled").alias("sampled"),
    )


def draw(docs: DataFrame, targets: Targets = Targets(), rate: float = 0.5, topics: int = 8, max_levels: int | None = None, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mix`` samples.

    Rows equal in doc_id and text are drawn together; null ids, texts, sources
    and languages count as in ``mix``; an empty table stays empty.
    """
    light = keep(profile(docs.select("doc_id", "source", "lang", "text", _crc()), ["doc_id", "source", "lang", "__crc"], topics))
    columns, table = _plan(light, targets, rate, max_levels)
    # columns of the documents travel in a struct, so that none clashes with a name in use here
    row = F.struct(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = profile(docs.select(row, "doc_id", "source", "lang", _crc()), ["row", "doc_id", "source", "lang", "__crc"], topics)
    return _sampled(whole, columns, table, seed).filter("__sampled").select("row.*")
