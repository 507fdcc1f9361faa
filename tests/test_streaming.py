from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.sources import codetree
from codeloom.streaming import incremental


def test_batches_add_up(spark, tmp_path):
    body = "def dup(a):\n    if a:\n        return [x for x in a if x]\n    return eval(a)  # TODO: now\n"

    def add(name, text):
        df = spark.createDataFrame([(name, text)], "p string, t string")
        codetree.from_table(df, F.col("p"), F.col("t")).write.mode("append").parquet(f"{tmp_path}/in")

    add("a.py", body)
    for name in ("b.py", "c.py"):
        stream = spark.readStream.schema(schemas.FILES).parquet(f"{tmp_path}/in")
        incremental.watch(stream, f"{tmp_path}/out", f"{tmp_path}/state", min_size=5, complexity_threshold=2, large_file_threshold=10, once=True).awaitTermination()
        add(name, body)
    found = spark.read.parquet(f"{tmp_path}/out/findings")
    assert {(r.section, r.n) for r in found.groupBy("section").agg(F.count("*").alias("n")).collect()} == {(s, 2) for s in ("complexity_results", "large_files", "todo_fixme", "bns_results")}
    (g,) = incremental.duplicates(spark, f"{tmp_path}/out").collect()
    assert g.num_duplicates == 2 and g.cross_file and [x.file for x in g.locations] == ["a.py", "b.py"]
