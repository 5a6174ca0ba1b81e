"""Training-data operators: one module for each, `queries` binds them to the test tables."""
