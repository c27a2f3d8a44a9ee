"""Sources and sinks: cycle logs, chip vectors, models, reports and traces."""

from tracewell.sources.files import assignment_map, read_chip_vectors, read_cycle_logs, read_reports, read_sources, write_report, write_traces
from tracewell.sources.models import latest_version, load_detectors, load_fcm, load_pca, load_version, publish_detectors, save_detectors, save_fcm, save_pca

__all__ = ["assignment_map", "latest_version", "load_detectors", "load_fcm", "load_pca", "load_version", "publish_detectors", "read_chip_vectors", "read_cycle_logs", "read_reports", "read_sources", "save_detectors", "save_fcm", "save_pca", "write_report", "write_traces"]
