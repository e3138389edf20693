"""DataFrame operators: validation, cleaning, star model, profiling, statistics, forecasting."""
