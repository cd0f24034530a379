"""Column expressions: no function here starts a job or needs Python workers."""
