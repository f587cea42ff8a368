from planwise.plans.plan import Filter, Plan, PlanError
from planwise.plans.validate import validate
from planwise.plans.compile import PlanReport, PlanResult, compile_plan

__all__ = ["Filter", "Plan", "PlanError", "PlanReport", "PlanResult", "compile_plan", "validate"]
