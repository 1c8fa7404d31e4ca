"""Column functions: projections that stay inside whole-stage code generation."""
