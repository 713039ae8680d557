"""Operators: annotation, grouping, neighbours, matching and merging, harmonising, lineage, audits, evaluation, export."""
