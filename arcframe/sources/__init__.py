"""Sources and sinks: text lines, directories, tar archives and filesystem images."""
