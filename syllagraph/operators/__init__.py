"""Set-based operators over curriculum tables: keys, edges, metrics, paths, schedules, reports, checks."""
