"""Report tables, workbooks of them, and comparisons between workbooks."""
