"""Batch job: a folder of messy files in, clean leads and their logs out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from leadspark.operators.staging import scratch
from leadspark.plans.files import organize_files, organize_lines
from leadspark.plans.organize import Organized
from leadspark.plans.refine import refine
from leadspark.profile import load_profile
from leadspark.sources import sinks
from leadspark.sources.intake import Intake


def _finish(organized: Organized, intake: Intake, out_dir: str, settings: str | dict | None) -> None:
    # each stage is read by several outputs: fix it once instead of computing it per output
    refined = refine(organized.materialize_leads(), settings).materialized().fix_results()
    sinks.organized_csv(refined, f"{out_dir}/organized")
    sinks.changes_csv(refined, f"{out_dir}/changes")
    sinks.write_quality_log(refined, f"{out_dir}/errors")
    intake.rejects.write.mode("overwrite").json(f"{out_dir}/rejects")


def run_job(spark: SparkSession, input_path: str, out_dir: str, profile: str | dict = "default",
            as_of: str = "now", settings: str | dict | None = None) -> None:
    """Organize and refine every file below ``input_path`` and write the results below ``out_dir``.

    What the job staged is removed at its end, also when it fails.
    """
    chosen = load_profile(profile)
    with scratch(spark):
        try:
            organized, intake = organize_files(spark, input_path, chosen, as_of)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"no such file: {input_path}") from error
            raise
        _finish(organized, intake, out_dir, settings)


def run_on_intake(intake: Intake, out_dir: str, profile: str | dict = "default", as_of: str = "now",
                  settings: str | dict | None = None) -> None:
    """The same job on lines that were read elsewhere (one micro-batch of a drop folder)."""
    organized, intake = organize_lines(intake, profile, as_of)
    _finish(organized, intake, out_dir, settings)
