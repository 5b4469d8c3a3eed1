"""Windows over stored blocks: equal to the plain ones, without a shuffle of rows."""

import random

import pytest
from conftest import AS_OF, activity, customer, weeks_ago

from cspulse.operators.windows import weekly_window_metrics
from cspulse.sources import blocks


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("block_rows", [3, 7, 4096])
def test_stored_blocks_equal_the_windows(spark, tables, block_rows):
    draw = random.Random(block_rows)
    facts = [activity(c, weeks_ago(draw.randint(0, 16), draw.randint(0, 3)), logins=draw.randint(0, 50),
                      usage=draw.choice([None, 10, 90]), seq=n % 10) for c in range(1, 9) for n in range(draw.randint(0, 40))]
    _, act = tables([customer(1)], list({f[0]: f for f in facts}.values()))
    name = blocks.write_blocks(act, buckets=4, block_rows=block_rows)
    try:
        plain = weekly_window_metrics(act, AS_OF)
        assert rows(blocks.stored_window_metrics(spark, name, AS_OF).select(*plain.columns)) == rows(plain)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_no_raw_row_is_shuffled(spark, tables):
    """Exchanges carry one row a customer (partial maxima) or a block, never an activity row."""
    _, act = tables([customer(1)], [activity(c, weeks_ago(k)) for c in range(1, 9) for k in range(1, 12)])
    name = blocks.write_blocks(act, buckets=4, block_rows=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.stored_window_metrics(spark, name, AS_OF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert exchanges
    for at in exchanges:  # what an exchange sends comes from the aggregate below it
        assert "Project" in lines[at + 1] or "Generate" in lines[at + 1] or "HashAggregate" in lines[at + 1]
        assert "activity_id" not in lines[at + 1] and "logins_count" not in lines[at + 1]
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    below = "\n".join(lines[window:]).split("Generate")[0]
    assert "Exchange" not in below.split("FileScan")[0] and "Bucketed: true" in below


def test_blocks_must_hold_a_frame(spark, tables):
    _, act = tables([customer(1)], [])
    with pytest.raises(ValueError, match="at least"):
        blocks.write_blocks(act, block_rows=2)
