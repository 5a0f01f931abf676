"""Sources and sinks: tables, migration scripts, shape documents, INSERT scripts."""
