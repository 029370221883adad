"""w5_frame_at_distance against paths summed in 60 decimal digits, also where a path is exactly 100 m."""

from __future__ import annotations

from bisect import bisect_left
from decimal import Decimal, localcontext
from itertools import groupby

from fieldtally.plans import domain, tracked

SF = "/root/testdata/sf0.01"


def test_frame_at_exact_distance(spark):
    poses = sorted(map(tuple, domain.poses(spark, SF).select("flight_id", "frame", "x", "y").collect()), key=lambda p: p[:2])
    want = set()
    with localcontext() as c:
        c.prec = 60
        for flight, rows in groupby(poses, key=lambda p: p[0]):
            last, length, path = None, Decimal(0), []
            for _, frame, x, y in rows:
                if x is not None:
                    length += Decimal(int((x - last[0]) ** 2 + (y - last[1]) ** 2)).sqrt() if last else 0
                    last = x, y
                path.append((length, frame))
            for length, frame in path:
                if frame % 10 == 0:
                    at = bisect_left(path, (length + 100 - Decimal(10) ** -40,))
                    want.add((flight, frame, path[at][1] if at < len(path) else None))
    assert set(map(tuple, tracked.w5_frame_at_distance(spark, SF).collect())) == want
