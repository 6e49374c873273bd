"""Registered queries over a cohort table derived from the given ``orders`` table."""
