"""sources of the event-pacing engine."""
