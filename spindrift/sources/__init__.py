"""Where records come from and go to: the source catalog and sinks."""
