"""DataFrame operators: each is ``f(df, ...) -> DataFrame`` or a fitter returning state."""
