"""functions of the event-pacing engine."""
