"""CSV text and files, tables found in messages, and report sinks."""
