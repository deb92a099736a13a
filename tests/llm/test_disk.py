"""What operators leave on disk while they run."""

import time

from oddsmith.llm import brown


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_brown_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i}") for i in range(60)], "doc_id long, text string")
    scored = brown.score(docs)
    for _ in range(20):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(key) == setting
    assert scored.count() == 60
