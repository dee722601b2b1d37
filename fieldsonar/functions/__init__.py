"""Column macros: closed-form functions that stay inside Spark's generated code."""
