"""Conversions that run on streams of event rows."""

from .events import modeling_stream, route_stream

__all__ = ["modeling_stream", "route_stream"]
