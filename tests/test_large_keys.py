"""Keys as large as the larger tables have them."""
import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def mails(path):
    day = dt.datetime(2001, 1, 1)
    rows = [dict(l_orderkey=36_000_000 + i, l_partkey=5_000_000 + 700 * i, l_suppkey=i, l_linenumber=4, l_quantity=1.0,
                 l_extendedprice=1.0, l_discount=0.0, l_returnflag="A", l_linestatus="O", l_shipdate=day) for i in range(3)]
    pq.write_table(pa.Table.from_pylist(rows), path / "lineitem.parquet")
    return str(path)


def test_mail_events_of_large_keys_are_ordered(spark, tmp_path):
    folder = mails(tmp_path)
    run = lambda name: entry.queries()[name](spark, folder).collect()
    assert len(run("a09_ingest_mail_events")) == 3
    # one mailbox, equal times: the complaint with the least key stands
    (row,) = run("a10_derive_suppressions")
    assert row.reason == "complaint"
    assert run("i14_suppression_summary")[0].n == 1
    assert len(run("i15_recent_problems")) == 3
    assert len(run("t04_stream_mail_events")) == 3
    assert len(run("t07_stream_suppressions")) == 1
