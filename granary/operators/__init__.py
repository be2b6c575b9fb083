"""Table, linear-algebra, statistics, profiling and scaling operators."""
