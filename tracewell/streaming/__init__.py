"""Structured Streaming jobs: verdicts, toggles and running averages."""

from tracewell.streaming.jobs import average_stream, score_stream, toggles_stream
from tracewell.streaming.ordered import keep_state_in_rocksdb, late_rows, ordered_toggles
from tracewell.streaming.verdicts import read_verdicts, verdict_stream

__all__ = ["average_stream", "keep_state_in_rocksdb", "late_rows", "ordered_toggles", "read_verdicts", "score_stream", "toggles_stream", "verdict_stream"]
