"""Chunks of streaming state: few calls to the store a micro-batch, and the results of a look at all rows."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from txnrisk.streaming import chunks
from txnrisk.streaming.asof import LatestBefore
from txnrisk.streaming.seconds import CardSeconds


class Store(dict):
    """A map state of one key that counts its calls."""

    calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key], self.calls = value, self.calls + 1

    def removeKey(self, key):
        del self[key]
        self.calls += 1


def _run(processor, batches):
    """(newest version and cells of every row, its versions, calls of each micro-batch, the store)."""
    store, newest, versions, calls = Store(), {}, {}, []
    processor.init(SimpleNamespace(getMapState=lambda *_: store))
    for batch in batches:
        before = store.calls
        for row in processor.handleInputRows((7,), iter(batch), None):
            cells = row.asDict()
            name = cells.get("trans_num") or cells.get("row_id")
            versions.setdefault(name, []).append(cells["version"])
            newest[name] = cells
        calls.append(store.calls - before)
    return newest, versions, calls, store


@pytest.mark.parametrize("order", ["time", "any"])
def test_velocity_of_a_heavy_card(order):
    rng = random.Random(5)
    rows = [Row(cc_num=7, trans_num=f"t{i}", unix_time=rng.randrange(40_000), units=rng.randrange(9)) for i in range(4_000)]
    rows += [Row(cc_num=7, trans_num=f"s{i}", unix_time=20_000, units=1) for i in range(1_500)]  # one second, more than a chunk
    if order == "time":
        rows.sort(key=lambda r: r.unix_time)
    else:
        rng.shuffle(rows)
    batches = [rows[i : i + 1_100] for i in range(0, len(rows), 1_100)]
    newest, versions, calls, store = _run(CardSeconds({"1h": 3_600}, 1 << 32, True, None), batches)
    cells = [(r.trans_num, r.unix_time, r.units) for r in rows]
    assert len(newest) == len(rows)
    for name, at, _ in cells[::40]:
        window = [units for _, t, units in cells if at - 3_600 <= t < at]
        got = newest[name]
        assert (got["TxnCount_1h"], round(got["TxnAmount_1h"] * 10_000)) == (len(window), sum(window))
    assert all(v == list(range(len(v))) for v in versions.values())
    # A call for every few hundred rows, not one for every second.
    assert sum(len(chunks.json.loads(v[3])) for v in store.values()) == len(rows)
    assert max(calls) <= (6 if order == "time" else 20)


def test_velocity_forgets_what_is_too_late():
    rows = [[Row(cc_num=7, trans_num=f"a{i}", unix_time=i, units=1) for i in range(1_200)], [Row(cc_num=7, trans_num="b", unix_time=900, units=1)],
            [Row(cc_num=7, trans_num="c", unix_time=2_000, units=1)], [Row(cc_num=7, trans_num="d", unix_time=1_150, units=1)]]
    newest, versions, _, store = _run(CardSeconds({"x": 100}, 50, True, None), rows)
    assert newest["b"]["TxnCount_x"] == 0 and versions["a901"] == [0]  # later than the lateness: its window has gone
    assert newest["c"]["TxnCount_x"] == 0 and newest["d"]["TxnCount_x"] == 0
    assert [name for v in store.values() for name in chunks.json.loads(v[3])] == ["c"]


@pytest.mark.parametrize("order", ["time", "any"])
def test_latest_event_of_a_heavy_key(order):
    rng = random.Random(6)
    rows = [Row(key=7, at=rng.randrange(9_000), row_id=f"t{i}") for i in range(4_000)]
    rows += [Row(key=7, at=rng.randrange(9_000), row_id=None) for _ in range(60)]
    if order == "time":
        rows.sort(key=lambda r: r.at)
    batches = [rows[i::4] if order == "any" else rows[i * 1_015 : (i + 1) * 1_015] for i in range(4)]
    newest, versions, calls, _ = _run(LatestBefore(1 << 32), batches)
    events, cells = [r.at for r in rows if r.row_id is None], [(r.at, r.row_id) for r in rows if r.row_id is not None]
    for at, name in cells:
        assert newest[name]["latest"] == max((e for e in events if e < at), default=None)
    assert all(v == list(range(len(v))) for v in versions.values())
    assert any(len(v) > 1 for v in versions.values()) == (order == "any")
    assert max(calls) <= 14


def test_cards_beside_rows_without_one_equal_batch(spark):
    from pyspark.sql import functions as F

    from txnrisk.operators import velocity
    from txnrisk.session import run_folder
    from txnrisk.streaming import seconds
    from txnrisk.streaming.source import append_sink, drain, file_stream

    rows = [(i, [None, 50, 94, 79][i % 4], 100 * (i * 7 % 40), 1.25 * i) for i in range(80)]
    df = spark.createDataFrame(rows, "trans_num long, cc_num long, unix_time long, amt double")
    seconds.use_rocksdb(spark)
    folder = run_folder(spark, "null-cards")
    df.coalesce(1).write.parquet(f"{folder}/in")
    out = seconds.velocity_versions(file_stream(spark, f"{folder}/in", df.schema))
    drain(append_sink(out, f"{folder}/data", f"{folder}/progress"))
    got = seconds.newest_versions(spark.read.schema(out.schema).parquet(f"{folder}/data")).drop("version")
    want = velocity.add_velocity(df).select(*got.columns)
    assert got.orderBy("trans_num").collect() == want.orderBy(F.col("trans_num")).collect()
