"""Structured Streaming: event tails, deadline sessions, plans over streams."""

from planwise.streaming.streams import (
    deadline_sessions,
    deliver,
    event_stream,
    read_latest,
    run_available,
    stream_plan,
    tail_terminal,
)

__all__ = ["deadline_sessions", "deliver", "event_stream", "read_latest", "run_available", "stream_plan", "tail_terminal"]
