"""Sources and sinks: delimited, line-list, vocabulary and event files; artifacts that are never overwritten."""
