"""Codes and fill values that stored data and report readers rely on."""

from __future__ import annotations

import datetime as dt

# These codes are stored in the school tables.
FIRST_PRESENTATION = "FP"
EVALUATION = "EV"
STATUS_ABSENT = 2
STATUS_LATE = 3
ADMINISTRATOR = "A"

# What a report shows for a virtual root of a task path.
ROOT_MINIMUM_ID = "NN"
ROOT_MINIMUM_VALUE = 0
ROOT_PREREQUISITE_NAME = "NA"
ROOT_BENCHMARK_DAYS = 1

# What a report shows where a student has not tried a task.
INCOMPLETE = "(incomplete)"
NO_TASK = 0
NO_VALUE = 0
NO_DATE = dt.datetime(1900, 1, 1)

# Filter argument that stands for "every id" next to None.
ALL_IDS = 0
