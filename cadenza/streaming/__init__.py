"""streaming of the event-pacing engine."""
