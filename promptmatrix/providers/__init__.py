"""Model calls: the one stage with side effects."""
