"""Column builders: no shuffle, no action, usable inside any select or agg."""
