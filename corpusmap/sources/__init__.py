"""Sources and sinks: response log, listings, pages, manifests, store tables, stand-ins built from the driver tables."""
