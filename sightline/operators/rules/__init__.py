"""The rule catalogue: one column expression a rule, evaluated in one select."""

from .catalogue import RULES, RuleSpec, evaluate, rule_table
from .context import site_context, with_measures

__all__ = ["RULES", "RuleSpec", "evaluate", "rule_table", "site_context", "with_measures"]
