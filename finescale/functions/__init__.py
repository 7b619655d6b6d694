from finescale.functions import metrics, physics, time, utm  # noqa: F401
