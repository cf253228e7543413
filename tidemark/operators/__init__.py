"""Operators: ``f(df, ...) -> DataFrame``, lazy, partitioned by series and time block."""
