"""The batch plan over a stream of words: a document's verdicts are made once all its words have come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import run_all
from ..sources.readers import WORDS


def stream_verdicts(spark: SparkSession, words_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Files of words that arrive in words_dir to verdicts in out_dir/verdicts/batch=N.

    A document may be spread over files and micro-batches. Words carry `last`, true on the last word of a document to
    arrive; words of documents that are not complete wait in out_dir/waiting, from where the next batch takes them. Each
    batch writes folders of its own number, so a batch that is run again after a failure writes the same again.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        jvm, conf = session._jvm, session._jsc.hadoopConfiguration()
        before = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/waiting/batch={number - 1}")
        if number and before.getFileSystem(conf).exists(before):
            batch = batch.unionByName(session.read.schema(batch.schema).parquet(before.toString()))
        batch = batch.persist()
        whole = batch.groupBy("doc").agg(F.bool_or("last").alias("done")).where("done").select("doc")
        batch.join(whole, "doc", "left_anti").write.mode("overwrite").parquet(f"{out_dir}/waiting/batch={number}")
        made = run_all(batch.join(whole, "doc", "left_semi").drop("last"))
        try:
            made.verdicts.write.mode("overwrite").parquet(f"{out_dir}/verdicts/batch={number}")
        finally:
            made.close()
            batch.unpersist()

    stream = spark.readStream.schema(f"{WORDS}, last boolean").parquet(words_dir)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
