"""One JSON array read from byte ranges, against a parse of the whole file."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.sources import json_ranges as R

TEXTS = st.text(alphabet='ab"\\{}[],: \né漢', max_size=12)
RECORDS = st.lists(
    st.fixed_dictionaries({"id": st.integers(), "text": TEXTS, "more": st.lists(st.dictionaries(TEXTS, TEXTS, max_size=2), max_size=2)}),
    max_size=6,
)


def in_ranges(data, size):
    """What the tasks and the driver do, for ranges of so many bytes."""
    state, depth, found = R.OUTSIDE, 0, []
    for at in range(0, len(data), size):
        mine = list(R.records_from(data[at:], state, depth, size))
        # with less data ahead the same records, but for the last ones
        near = list(R.records_from(data[at : at + size + 5], state, depth, size))
        assert near == mine or (near[-1] is None and near[:-1] == mine[: len(near) - 1])
        found += mine
        part = data[at : at + size]
        state, change = R.effect(part, state)
        depth += change
    assert (state, depth) == (R.OUTSIDE, 0)
    return [json.loads(r) for r in found]


@settings(max_examples=300, deadline=None)
@given(records=RECORDS, size=st.sampled_from([1, 2, 3, 7, 50, 10_000]), indent=st.sampled_from([None, 2]), ascii=st.booleans())
def test_ranges_of_any_size_give_every_record_once(records, size, indent, ascii):
    data = json.dumps(records, indent=indent, ensure_ascii=ascii).encode()
    assert in_ranges(data, size) == records


@pytest.mark.parametrize("range_bytes", [64, 5_000, R.RANGE_BYTES])
def test_a_large_array_is_read_by_several_tasks(spark, tmp_path, range_bytes):
    rng = random.Random(1)
    rows = [{"id": i, "text": "".join(rng.choice('ab"\\{}[], é') for _ in range(rng.randrange(80)))} for i in range(300)]
    rows[7]["text"] = "long } \\ " * 20_000
    rows[9] = {"id": 9, "other": {"text": [1, {"x": "]"}]}}
    (tmp_path / "one.json").write_text(json.dumps(rows, ensure_ascii=False, indent=1))
    (tmp_path / "two.json").write_text("[]")
    if range_bytes == 64:
        rows = rows[:7]
        (tmp_path / "one.json").write_text(json.dumps(rows))
    schema = R.T.StructType([R.T.StructField("id", R.T.LongType()), R.T.StructField("text", R.T.StringType())])
    whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    got = R.read_large_json_array(spark, str(tmp_path), schema, range_bytes)
    if range_bytes < R.RANGE_BYTES:
        assert got.rdd.getNumPartitions() > 5
    want = sorted((tuple(r) for r in whole.collect() if r.id is not None))
    assert sorted(map(tuple, got.collect())) == want and len(want) == len(rows)


def test_a_broken_array_fails(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": 1}, {"id": "2')
    schema = R.T.StructType([R.T.StructField("id", R.T.LongType())])
    with pytest.raises(ValueError, match="ends inside"):
        R.read_large_json_array(spark, str(tmp_path), schema)


def test_effects_of_all_states():
    rng = random.Random(2)
    for _ in range(3_000):
        data = "".join(rng.choice('ab"\\{}[]') for _ in range(rng.randrange(9))).encode()
        assert R.effects(data) == [R.effect(data, s) for s in (R.OUTSIDE, R.INSIDE, R.ESCAPED)]


def test_small_ranges_share_tasks(spark, tmp_path):
    rows = [{"id": i, "text": "some words " * 20} for i in range(200)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    schema = R.T.StructType([R.T.StructField("id", R.T.LongType())])
    got = R.read_large_json_array(spark, str(tmp_path), schema, 100)
    assert 5 < got.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in got.collect()) == list(range(200))
