"""State-window analytics on PySpark: record, roll up, compare."""

from .operators.comparison import compare, comparison
from .operators.recording import Pipeline, Projection, RollUp, Segment, Tag, WindowDefinition, all_active, any_active
from .plans.comparison import Activity, Normalization, Plan, Scope, Selector, as_of, lead_lag

__all__ = [
    "Activity", "Normalization", "Pipeline", "Plan", "Projection", "RollUp", "Scope", "Segment", "Selector", "Tag", "WindowDefinition",
    "all_active", "any_active", "as_of", "compare", "comparison", "lead_lag",
]
