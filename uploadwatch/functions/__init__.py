"""Column functions over texts, URLs and pages.  They take and return Columns."""
