"""Sources and preparation: catalogue / transaction scans, type hardening, test-table adapter, sinks."""
