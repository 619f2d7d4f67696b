from pathgrove.operators import search as s
from pathgrove.streaming import watch


def test_watch(spark, make, tmp_path):
    folder = str(tmp_path / "entries")
    make([("a.txt", 5), ("b.bin", 5000)]).entries.write.parquet(folder)
    query = watch.watch(spark, folder, s.size("+1k")).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    assert [r["path"] for r in spark.table("found").collect()] == ["b.bin"]
    assert watch.newest(spark.read.parquet(folder).union(spark.read.parquet(folder))).count() == 2
