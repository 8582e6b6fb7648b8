"""Sources and sinks: files, git, diffs, coverage, compilation databases, configuration."""
