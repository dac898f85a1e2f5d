"""Arguments that the registered queries and the check SQL share."""

import datetime as dt

AS_OF = dt.date(2024, 2, 29)
RANGE = (dt.date(1996, 1, 1), dt.date(1998, 12, 31))
ATTENDANCE_RANGE = (dt.date(1996, 1, 3), dt.date(1996, 1, 20))
BUCKETS = (
    (dt.date(1995, 1, 1), dt.date(1996, 12, 31)),
    (dt.date(1997, 1, 1), dt.date(1998, 12, 31)),
    (dt.date(1999, 1, 1), dt.date(2000, 12, 31)),
)
# The second bucket overlaps the first.
OVERLAPPING = (
    (dt.date(1995, 1, 1), dt.date(1997, 6, 30)),
    (dt.date(1996, 7, 1), dt.date(1998, 12, 31)),
    (dt.date(1998, 1, 1), dt.date(2000, 12, 31)),
)
# The second bucket reaches beyond the first start and the third end.
CLIPPED = (
    (dt.date(1997, 1, 1), dt.date(1997, 12, 31)),
    (dt.date(1995, 1, 1), dt.date(2001, 12, 31)),
    (dt.date(1999, 1, 1), dt.date(1999, 12, 31)),
)
# The second bucket has no end, so nothing falls into it.
NULL_BOUND = (
    (dt.date(1995, 1, 1), dt.date(1996, 12, 31)),
    (dt.date(1997, 1, 1), None),
    (dt.date(1999, 1, 1), dt.date(2000, 12, 31)),
)
STUDENT = 101
LIST = (3, 17, 101, 140)
STAFF = 1
SUBJECT = 1
WIDE_BANDS = ((0, 1_000_000, "low"), (500_000, 3_999_999, "middle"), (4_000_001, 2_000_000_000, "top"))
# Attempts that the maintained tables take back from this day on, and the type not given again.
TAKEN_BACK = (dt.date(1997, 1, 1), "AS")
