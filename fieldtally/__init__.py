"""Survey and programme-monitoring analytics as Spark jobs."""

from fieldtally.errors import DatasetNotFound, NotComputable, ReportError
from fieldtally.operators.cleaning import CleaningPlan, clean_dataset
from fieldtally.operators.filters import safe_filter
from fieldtally.operators.fivew import five_w
from fieldtally.operators.indicators import evaluate_indicators
from fieldtally.operators.measures import evaluate_measure
from fieldtally.operators.period import Period, parse_period
from fieldtally.operators.pii import drop_pii, pii_detect
from fieldtally.operators.profile import profile
from fieldtally.operators.rowids import ensure_row_ids
from fieldtally.plans.adhoc import adhoc_sql
from fieldtally.plans.report import evaluate_registry, five_w_report
from fieldtally.session import configure
from fieldtally.sources.tables import Catalog, scan_csv, scan_parquet

__all__ = [
    "Catalog", "CleaningPlan", "DatasetNotFound", "NotComputable", "Period", "ReportError", "adhoc_sql",
    "clean_dataset", "configure", "drop_pii", "ensure_row_ids", "evaluate_indicators", "evaluate_measure",
    "evaluate_registry", "five_w", "five_w_report", "parse_period", "pii_detect", "profile", "safe_filter",
    "scan_csv", "scan_parquet",
]
