"""Diff, merge and append plans (dry run, then apply)."""
