"""Sources and sinks: folders of files, registries, caches, JSON lines, and the workspace built of them."""
