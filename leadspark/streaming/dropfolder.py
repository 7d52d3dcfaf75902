"""Continuous intake: every new file in a drop folder is organized as an isolated job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leadspark.operators.staging import materialize, scratch
from leadspark.plans.job import run_on_intake
from leadspark.profile import load_profile
from leadspark.sources.intake import Intake, logged_files, with_places


def watch_folder(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, profile: str | dict = "default",
                 as_of: str = "now", settings: str | dict | None = None, max_files: int = 100_000,
                 trigger: dict | None = None) -> StreamingQuery:
    """Start the stream. A micro-batch holds at most ``max_files`` new files, whole, and knows of the empty ones by the stream's file log.
    A batch is a whole distributed job of some two hundred stages, so it should hold many files: a thousand leave the cluster waiting.
    Every operator keeps files apart by ``file_id``, so no state crosses batches. Results go to one folder per batch, which a
    retried batch overwrites; what a batch staged is removed at its end.
    """
    load_profile(profile)
    lines = (spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
             .schema("value string").text(folder)
             .select("value", "_metadata.file_path", "_metadata.file_block_start"))

    def process(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            listed = materialize(logged_files(batch.sparkSession, checkpoint, batch_id))
            run_on_intake(Intake(with_places(batch), listed), f"{out_dir}/batch={batch_id}", profile, as_of, settings)

    return (lines.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
