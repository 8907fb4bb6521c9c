"""Tables, corpus files, traces and sinks."""
