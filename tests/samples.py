"""Small random logs and plain-Python versions of the sequential rules."""

from __future__ import annotations

import datetime as dt
import random

LOG_FIELDS = (
    "id bigint, ts timestamp_ntz, source_ip string, method string, path string, "
    "status_code int, ml_score double"
)
START = dt.datetime(2024, 1, 1, 0, 10)


def random_log(seed: int, rows: int = 400, seconds: int = 2400, addresses: int = 4) -> list[tuple]:
    """Log rows with ties, null status codes and one address that holds most of the rows."""
    draw = random.Random(seed)
    paths = ["/", "/api/auth/login", "/admin", "/x", "/y", "/z"]
    log = []
    for number in range(rows):
        busy = draw.random() < 0.6
        at = START + dt.timedelta(milliseconds=draw.randrange(seconds * 4) * 250)
        log.append(
            (
                number,
                at,
                "10.0.0.1" if busy else f"10.0.0.{draw.randrange(2, 2 + addresses)}",
                draw.choice(["GET", "post", "POST"]),
                draw.choice(paths),
                draw.choice([200, 200, 401, 403, 500, None]),
                draw.choice([0.1, 0.5, 0.7, 0.71, 0.9, 1.0]),
            )
        )
    return log


def expected_counts(log: list[tuple]) -> dict[int, dict]:
    result = {}
    for number, at, ip, _, _, _, _ in log:
        def within(seconds: int) -> list[tuple]:
            first = at - dt.timedelta(seconds=seconds)
            return [row for row in log if row[2] == ip and first <= row[1] <= at]

        minute, five = within(60), within(300)
        status = [row[5] or 0 for row in minute]
        result[number] = {
            "ip_req_count_1m": len(minute),
            "ip_req_count_5m": len(five),
            "ip_fail_count_1m": sum(code >= 400 for code in status),
            "ip_fail_count_5m": sum((row[5] or 0) >= 400 for row in five),
            "unique_paths_1m": len({row[4] for row in minute}),
            "avg_status_code_1m": sum(status) / len(status),
            "burst_rate": len(within(5)) / 5.0,
        }
    return result


def expected_fires(candidates: list[tuple], pause: int = 60, last: dict | None = None) -> set:
    """Ids of the (id, ts, ip, kind) that fire, taken one by one in (ts, id) order."""
    last, fired = dict(last or {}), set()
    for number, at, ip, kind in sorted(candidates, key=lambda row: (row[1], row[0])):
        before = last.get((ip, kind))
        if before is None or at - before >= dt.timedelta(seconds=pause):
            last[ip, kind] = at
            fired.add(number)
    return fired


def expected_reputation(events: list[tuple]) -> dict[str, float]:
    """Weighted means of the (id, ts, ip, score), taken one by one in (ts, id) order."""
    result: dict[str, float] = {}
    for _, _, ip, score in sorted(events, key=lambda row: (row[1], row[0])):
        contribution = 1.0 - score
        old = result.get(ip)
        result[ip] = contribution if old is None else 0.1 * contribution + 0.9 * old
    return result
