"""Where points come from: files, rows in memory, generators."""
