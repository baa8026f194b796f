"""Plan shapes shared by the operators: hot-key split, carried windows, ranked totals."""
