"""Sources and sinks: explicit schemas, readers, validated exports."""
