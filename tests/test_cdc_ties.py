"""The change-capture queries on logs where most changes of a user tie, against DuckDB."""

import duckdb
import pytest

from compare import duck_rows, spark_rows
from tideframe import plans

ORDER = "ORDER BY lsn DESC NULLS LAST, (op = 'D') DESC"
# the rule of ``cdc.dedupe`` for what ORDER leaves open: rows closed so are one of its answers
CLOSED = {name: f"{ORDER}, value DESC NULLS LAST" for name in ("cdc_apply_files", "cdc_apply_hard", "cdc_apply_soft", "cdc_tombstones")}
CLOSED["cdc_schema_append"] = f"{CLOSED['cdc_apply_hard']}, (CASE WHEN event_id % 2 <> 0 THEN event_id END) DESC NULLS LAST"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Up to eight events a user, all of one ``lsn`` where they have one, in both batches, half of the users without deletes; those of ``below`` have negative ids."""
    out = {}
    for name, sign in (("above", 1), ("below", -1)):
        out[name] = tmp_path_factory.mktemp(name)
        ids = f"SELECT {sign} * (i % 60 + 1 + i // 60 * 10007) AS event_id, i % 60 AS u FROM range(480) t(i)"
        rows = f"SELECT event_id, nullif(u, 7) AS user_id, CASE WHEN event_id % 7 <> 0 THEN event_id * 31 % 3 END::DOUBLE AS value FROM ({ids}) WHERE u % 2 = 1 OR event_id % 4 <> 0"
        duckdb.sql(f"COPY ({rows}) TO '{out[name]}/events.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("log", ["above", "below"])
@pytest.mark.parametrize("name", sorted(CLOSED))
def test_ties_are_settled_within_the_sql(spark, logs, name, log):
    sql = plans.ORACLES[name]
    assert sql.count(ORDER) == 1
    names, got = spark_rows(plans.QUERIES[name](spark, str(logs[log])))
    assert got and (names, got) == duck_rows(sql.replace(ORDER, CLOSED[name]), logs[log])
