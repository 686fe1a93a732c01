import random
from collections import Counter

from duplika.operators import evaluate, seeds
from duplika.streaming import seed_frequencies


def test_seed_frequencies(spark, tmp_path):
    rng = random.Random(1)
    schema = "species string, chrom string, seq string"
    rows = [("s", f"c{i}", evaluate.random_sequence(300, rng)) for i in range(6)]
    rows += rows[:2]
    for i in (0, 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = seed_frequencies(stream, 8, 4).writeStream.outputMode("complete").format("memory").queryName("freq").trigger(availableNow=True).start()
    q.awaitTermination()
    want = Counter(r.kmer for r in seeds.minimizers(spark.createDataFrame(rows, schema), 8, 4).collect())
    assert {r.kmer: r.places for r in spark.table("freq").collect()} == want
