"""Fixed values that define the published measures."""

# Thresholds in seconds, histogram edges, floors and windows.
SEVERE_SECONDS = 300
GHOST_SECONDS = 3600
ON_TIME_FROM, ON_TIME_UNTIL = -60, 300
DELAY_EDGES = [-3600, -300, -180, -120, -90, -60, -30, 0, 30, 60, 90, 120, 150, 180, 240, 300, 420, 600, 900, 1800, 3600]
GAP_EDGES = [0, 0.5, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 60, 90, 120, 180, 240]
MOST_GAP_MINUTES = 240
RATE_FLOOR = 30
WILSON_Z = 1.96
WINDOW_DAYS = {"day": 1, "week": 7, "month": 30}
SHIFTS = {"am_peak": (6, 8), "midday": (9, 14), "pm_peak": (15, 18), "evening": (19, 22)}
UNROUTED, UNKNOWN_STOP = "__unrouted__", "__unknown_stop__"
BANDS = {"empty": (0,), "many_seats": (1,), "few_seats": (2,), "standing": (3, 4), "full": (5,)}
SCORE_CAP = 9999.9999
SKIPPED, CANCELED = 1, 3
