"""Property: any sequence of upsert batches equals a last-write-wins model."""

import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from chainlake.operators import sink as S

rows = st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["a", "b", None])), min_size=1, max_size=8)


@settings(max_examples=6, deadline=None)
@given(st.lists(rows, min_size=1, max_size=3), st.booleans())
def test_upserts_equal_model(spark, tmp_path_factory, batches, replay_last):
    path = str(tmp_path_factory.mktemp("prop") / uuid.uuid4().hex)
    model = {}
    plan = list(enumerate(batches)) + ([(len(batches) - 1, batches[-1])] if replay_last else [])
    for bid, batch in plan:
        data = [("c", (k * 40_000) // 100_000, k * 40_000, v, pos) for pos, (k, v) in enumerate(batch)]
        df = spark.createDataFrame(data, "chain string, block_bucket long, number long, v string, p long")
        S.upsert(S.with_order(df, bid, "p").drop("p"), path, ["chain", "number"])
        for pos, (k, v) in enumerate(batch):
            model[k * 40_000] = v              # later position in a batch wins, like _pos
    got = {r["number"]: r["v"] for r in spark.read.parquet(path).select("number", "v").collect()}
    assert got == model
