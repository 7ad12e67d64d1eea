"""Sources and sinks (survey section 2.A)."""
