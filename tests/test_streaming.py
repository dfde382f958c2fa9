"""Streaming ingest: each new file is appended exactly once across runs."""
import datetime as dt
import os
import tempfile

from montevar.streaming.ingest import ingest_prices, read_prices


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_ingest_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="montevar-stream-")
    src, out, ckpt = (os.path.join(base, p) for p in ("src", "table", "ckpt"))
    os.makedirs(src)
    hdr = "Date,Open,High,Low,Close,Volume\n"
    _write(os.path.join(src, "AAA.csv"), hdr + "31-Dec-13,\"1,200.50\",1,1,1,1\n30-Dec-13,1199,1,1,1,1\n")
    _write(os.path.join(src, "BBB.csv"), hdr + "31-Dec-13,10,1,1,1,1\n")
    ingest_prices(spark, src, out, ckpt).awaitTermination()
    first = spark.read.parquet(out)
    assert sorted((r.symbol, r.date, r.open) for r in first.collect()) == [
        ("AAA", dt.date(2013, 12, 30), 1199.0), ("AAA", dt.date(2013, 12, 31), 1200.5),
        ("BBB", dt.date(2013, 12, 31), 10.0)]
    _write(os.path.join(src, "CCC.csv"), hdr + "02-Jan-98,5.5,1,1,1,1\n")
    ingest_prices(spark, src, out, ckpt).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 4 and {r.symbol for r in rows} == {"AAA", "BBB", "CCC"}


HDR = "Date,Open,High,Low,Close,Volume\n"


def test_progress_belongs_to_the_table(spark):
    """No location given: a later run, as from another session, goes on where the last one ended."""
    base = tempfile.mkdtemp(prefix="montevar-stream-")
    src, other, out = (os.path.join(base, p) for p in ("src", "other", "table"))
    os.makedirs(src)
    os.makedirs(other)
    _write(os.path.join(src, "AAA.csv"), HDR + "31-Dec-13,1,1,1,1,1\n")
    _write(os.path.join(src, "BF B.csv"), HDR + "31-Dec-13,2,1,1,1,1\n")
    ingest_prices(spark, src, out).awaitTermination()
    _write(os.path.join(src, "CCC.csv"), HDR + "31-Dec-13,3,1,1,1,1\n")
    sc, was = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="montevar-ckpt-"))  # as after a restart
    ingest_prices(spark, src + "/", out).awaitTermination()
    _write(os.path.join(other, "DDD.csv"), HDR + "31-Dec-13,4,1,1,1,1\n")
    ingest_prices(spark, other, out).awaitTermination()             # another source into the same table
    ingest_prices(spark, src, out).awaitTermination()               # nothing new
    got = sorted((r.symbol, r.open) for r in read_prices(spark, out).collect())
    assert got == [("AAA", 1.0), ("BF B", 2.0), ("CCC", 3.0), ("DDD", 4.0)]
    two = os.path.join(base, "two")
    ingest_prices(spark, other, two).awaitTermination()             # and into another table
    assert [r.symbol for r in read_prices(spark, two).collect()] == ["DDD"]
    if was:
        sc.setCheckpointDir(os.path.dirname(was))
