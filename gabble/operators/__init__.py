"""Table-to-table operators: clean, match, select, score, resume, report, test."""
