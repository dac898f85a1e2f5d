"""Alerts from a running feed of changed rows."""

from tasktrail.streaming.alert_stream import FILES_PER_BATCH, alert_stream, change_feed

__all__ = ["FILES_PER_BATCH", "alert_stream", "change_feed"]
