"""Sources (driver tables, delimited files) and sinks."""
