"""Sources, derived record tables, validation and sinks."""
