from tabloom.streaming.drift import drift_stream, window_drift  # noqa: F401
from tabloom.streaming.scoring import score_stream  # noqa: F401
