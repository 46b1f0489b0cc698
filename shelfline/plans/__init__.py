"""Driver-table bindings: each registered query and its SQL counterpart."""
