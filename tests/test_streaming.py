from pyspark.sql import functions as F

from strandloom.operators.periods import periods_and_gaps
from strandloom.plans.problems import site_stretches
from strandloom.streaming.live import live_periods, sessions, windowed_counts


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_live_periods_end_where_the_batch_operator_ends(spark, sf, tmp_path):
    s = site_stretches(spark.read.parquet(f"{sf}/sites.parquet")).withColumn("entity", F.concat_ws("/", "list_id", "chrom")).where("a < 1048576 * 4")
    for i in range(3):
        s.where(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, live_periods(stream, "entity", "a", "b", 40), "live", "update")
    # of the periods seen while they grew, the longest at each place is the last
    last = {(r.entity, r.start_pos, r.end_pos) for r in got.collect()}
    want = {(r.entity, r.start_pos, r.end_pos) for r in periods_and_gaps(s, ["entity"], "a", "b").where("kind = 'period'").collect()}
    assert want <= last and all(any(e == w[0] and w[1] <= a and b <= w[2] for w in want) for e, a, b in last)


def test_windows_and_sessions(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = run(spark, windowed_counts(stream, "ts", "event_type", size="1 day"), "win", "complete").groupBy().sum("n").first()[0]
    assert got == e.count()
    n = run(spark, sessions(stream, "ts", "user_id"), "ses", "complete")
    assert n.groupBy().sum("n").first()[0] == e.count() and n.where("end <= start").count() == 0
