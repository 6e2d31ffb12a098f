"""Table scans, inventories, loads and script sinks."""
