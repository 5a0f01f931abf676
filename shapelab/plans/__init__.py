"""Evaluation of schema changes: statements, rules, verdicts, estimates, differences."""
