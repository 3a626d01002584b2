"""plans of the event-pacing engine."""
