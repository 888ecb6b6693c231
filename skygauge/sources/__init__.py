"""Sources and sinks: topics, payload files, log text and the keyed output tables."""
