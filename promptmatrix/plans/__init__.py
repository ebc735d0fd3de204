"""A configuration compiled to a plan, and its execution."""
