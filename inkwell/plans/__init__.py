"""Queries that put the operators to work on the test tables, their SQL equivalents, and the measuring campaign."""
