"""The two long ways: matrix to clean matrix, clean matrix to metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convert, evaluate, impute, matrix, models, qc
from ..sources.shared import written
from .config import QcConfig
from .ledger import Ledger


@dataclass
class QcResult:
    """The clean matrix and what each step removed."""

    clean: DataFrame
    samples: DataFrame
    probes: DataFrame
    correlations: DataFrame


def quality_control(long: DataFrame, config: QcConfig | None = None, source: str | None = None, ledger: Ledger | None = None, inputs: Mapping[str, str] | None = None) -> QcResult:
    """Convert, filter samples (missing and largest in one aggregation), filter probes, impute, filter by correlation.

    ``source`` is the value type; None detects it, which is a job of its own.  With a ledger
    and the digests of ``inputs`` each step's result stays, and a run that was cut short goes on
    from the last one.  Without, two tables go to the shared folder until the process ends.
    """
    config = config or QcConfig()
    if ledger is not None and not inputs:
        raise ValueError("a ledger needs the digests of the inputs")
    made_of: dict[str, str] = dict(inputs or {})

    def step(name: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
        """The result of a step, which depends on all steps before it."""
        if ledger is None:
            return written(build(), name)
        out = ledger.step(name, build, made_of, **parameters)
        made_of[name] = ledger.digest(name, made_of, **parameters)
        return out

    if source is None:
        source = (step("type", lambda: convert.type_share(long)) if ledger else convert.type_share(long)).first()["data_type"]
    long = convert.convert(long, source, config.target)
    samples, probes = qc.dimensions(long)
    profile = qc.keep_samples(qc.sample_profile(long, samples, probes), config.sample_missing, config.largest)
    kept = step("kept-samples", lambda: profile.where("kept").select(*qc.SAMPLE), source=source, target=config.target, missing=config.sample_missing, largest=config.largest)
    probe_profile = qc.probe_profile(long, kept, probes, config.probe_missing)
    cells = lambda: matrix.align_kept(long, kept, probe_profile.where("kept").select("accession", "probe"))
    filled = step("filled", lambda: impute.simple(cells(), config.imputer), missing=config.probe_missing, imputer=config.imputer)
    correlations = qc.keep_correlated(qc.mean_correlations(filled), config.correlation)
    if ledger is not None:
        correlations = step("correlations", lambda: qc.keep_correlated(qc.mean_correlations(filled), config.correlation), least=config.correlation)
    clean = filled.join(correlations.where("kept").select(*qc.SAMPLE), qc.SAMPLE, "left_semi")
    return QcResult(clean, profile, probe_profile, correlations)


def benchmark(predictions: DataFrame, dataset: str, model: str, status: str, control: str, error_on: str = "accel") -> DataFrame:
    """Acceleration over all rows, metrics over controls, pooled rows beside the datasets'."""
    full = models.acceleration(predictions, [dataset, model], model=model)
    return evaluate.overall_and_by_dataset(full.where(F.col(status) == control), dataset, model, error_on=error_on)
