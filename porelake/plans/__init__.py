"""Queries over the driver's tables: one module per family, each registers its queries."""

from porelake.plans import assessment, chunking, kernels, layers, sequences, signals, tables_and_joins  # noqa: F401
