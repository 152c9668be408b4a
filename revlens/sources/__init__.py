"""Sources and sinks: declared schemas, the table catalog, the benchmark
adapter, a loader for raw CRM tables, and table / mart writers."""
