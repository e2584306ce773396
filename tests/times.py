"""Times of day that the tests share."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)
