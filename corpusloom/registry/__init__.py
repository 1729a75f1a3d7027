"""Queries over the test tables, each with an equivalent SQL text where there is one."""
