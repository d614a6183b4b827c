"""Small registry used by the query modules."""

from __future__ import annotations

from checks.views import oracle


class Queries:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Register the decorated (spark, sf_dir) function, with its SQL counterpart."""
        def wrap(fn):
            key = name or fn.__name__

            def run(spark, sf_dir):
                from chronoline.session import apply_defaults
                return fn(apply_defaults(spark), sf_dir)

            run.__name__, run.__doc__ = key, fn.__doc__
            self.queries[key] = run
            if sql is not None:
                self.oracles[key] = oracle(sql)
            return fn
        return wrap
