"""tallyscope: table audit, cleaning plans and exploratory tables on Spark.

    from tallyscope import assess, CleaningPlan
    audit = assess(df, order_by=["id"])
    cleaned, plan = CleaningPlan(audit.suggestions).fit_transform(df)
"""

from .config import AuditConfig
from .plans.cleaning import CleaningPlan, FittedPlan, before_after, category_codes, clean
from .plans.rules import Assessment, Suggestion, assess, suggest
from .sources.csv import read_csv, write_csv, write_log_text, write_parquet

__all__ = [
    "AuditConfig", "Assessment", "Suggestion", "assess", "suggest", "CleaningPlan", "FittedPlan", "clean",
    "before_after", "category_codes", "read_csv", "write_csv", "write_parquet", "write_log_text",
]
