"""Sources and sinks: page folders, finished outputs, settings files, payload files."""
