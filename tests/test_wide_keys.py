"""Order keys whose listings' ``ord`` no bigint holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_entry import SF, registry

#: Nothing that the queries take of a key changes by so much but its digits.
SHIFT = 60_060_000
NAMES = ["constrained_groups", "drop_reason_histogram", "normalize_listings_full", "ttl_filter", "transaction_cascade", "pair_evidence", "hint_left_join", "band_join_close", "semi_join"]


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    out = tmp_path_factory.mktemp("shifted")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(t)
        con.execute(f"COPY (SELECT * {f'REPLACE ({key} + {SHIFT} AS {key})' if key else ''} FROM '{SF}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out)


def told(df, by=0):
    """The rows, less links that show keys; keys less what they were shifted by."""
    keys = ("ord", "a_ord", "b_ord", "property_id")
    columns = [c for c in sorted(df.columns) if c != "key_url"]
    shown = df.select([(F.col(c).cast("decimal(38,0)") - F.lit(str(by * 10**12)).cast("decimal(38,0)")).cast("long").alias(c) if c in keys else F.col(c) for c in columns])
    return sorted((tuple(map(str, r)) for r in shown.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_large_keys_change_no_result(spark, shifted, name):
    query = registry()[0][name]
    got, expected = query(spark, shifted), query(spark, SF)
    assert {t for c, t in expected.dtypes if c.endswith("ord")} <= {"bigint"} and {t for c, t in got.dtypes if c.endswith("ord")} <= {"decimal(38,0)"}
    assert told(got, SHIFT) == told(expected)
