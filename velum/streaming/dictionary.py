"""Documents that arrive as a stream: each micro-batch is analysed and extends the stored dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from velum.operators import extract, pseudonyms, redact
from velum.sources.tables import saved


def versions(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The dictionary as it stood before a batch: the keys that earlier batches added, each in a version of its own.

    Versions are never changed, so a batch can be run again.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in found if n.startswith("v=") and int(n.removeprefix("v=")) < before and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return spark.read.schema(pseudonyms.DICTIONARY).parquet(*[f"{folder}/{n}" for n in done]) if done else None


def pseudonymise(docs: DataFrame, out: str, dictionary: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over a stream docs(doc_id, text) that writes (doc_id, text, entities_replaced) to out/batch=N.

    A batch writes only the keys it adds, beside those of earlier ones; a batch that is run again writes the same rows.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, dictionary, n)
        entities = saved(extract.entities(batch), "stream-entities")
        pseudonyms.assign_new(pseudonyms.arrivals(entities), known).write.mode("overwrite").parquet(f"{dictionary}/v={n}")
        named = pseudonyms.enrich(entities, versions(spark, dictionary, n + 1))
        named = named.withColumn("pseudonym", named["dictionary_pseudonym"])
        redact.redact(batch, named).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
