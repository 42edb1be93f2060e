"""Operators over records, issues and jobs."""
