"""Claims-frequency analytics on Spark.

Main entry points (all take and return Spark DataFrames):

    from claimwise import build_session, read_policies_csv, engineer, split
    from claimwise import fit_glm, fit_boosted, BoostParams
    from claimwise import metric_rows, lift_table, pr_curve, pr_summary, top_errors

``claimwise.plans.study.run`` runs the whole study; ``__spark_entry__`` at the
repository root registers every operator query with its DuckDB oracle.
"""

__version__ = "0.1.0"

from .operators.boost import BoostParams, fit_boosted
from .operators.evaluate import class_metrics, error_frame, metric_rows, top_errors
from .operators.features import engineer
from .operators.glm import fit_glm
from .operators.ordering import exact_quantiles, global_row_number, prefix_sums
from .operators.ranking import lift_table, pr_curve, pr_summary
from .operators.target import TargetPrep, split
from .session import build_session, materialize
from .sources.tables import policies, read_policies_csv

__all__ = [
    "BoostParams", "TargetPrep", "build_session", "class_metrics", "engineer", "error_frame", "exact_quantiles",
    "fit_boosted", "fit_glm", "global_row_number", "lift_table", "materialize", "metric_rows", "policies",
    "pr_curve", "pr_summary", "prefix_sums", "read_policies_csv", "split", "top_errors",
]
