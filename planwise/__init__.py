"""planwise: declarative, inspectable table analysis compiled to Spark DataFrames.

A ``Dataset`` is a typed table with stable field IDs; a ``Plan`` is a validated
declarative analysis (dedupe, filters, missing policy, time bucket, grouping,
one aggregation, sort).  ``compile_plan`` turns the pair into a lazy DataFrame
that Catalyst optimises like any other query.  Results are always computed over
all rows: limits reject, they never sample or truncate.
"""

from planwise.dataset import Dataset, Field
from planwise.plans.plan import Filter, Plan, PlanError
from planwise.plans.compile import PlanResult, compile_plan
from planwise.session import build_session, scratch_dir

__all__ = [
    "Dataset",
    "Field",
    "Filter",
    "Plan",
    "PlanError",
    "PlanResult",
    "build_session",
    "compile_plan",
    "scratch_dir",
]
