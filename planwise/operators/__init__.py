"""Distributed operators: filters, aggregation, diagnostics, marks, run logs."""
