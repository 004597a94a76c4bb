"""Scene catalog, scene cells, request documents and sinks."""
