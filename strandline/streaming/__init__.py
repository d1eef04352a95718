"""Streaming: raw capture, stateful linking, relabelling of touched sessions."""
