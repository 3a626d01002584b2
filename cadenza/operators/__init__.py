"""operators of the event-pacing engine."""
