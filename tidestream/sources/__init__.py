"""Sources and sinks: packets, containers, folders, tables, messages."""
