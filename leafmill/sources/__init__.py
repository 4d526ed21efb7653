"""Sources and sinks: page files, JSONL logs, layout JSON, book files."""
