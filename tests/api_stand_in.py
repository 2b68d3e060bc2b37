"""Answers in place of an API; the first call of a process fails, as networks do."""

import json

_calls = []


def fetch(endpoint: str, year: int) -> str:
    _calls.append(year)
    if len(_calls) == 1:
        raise OSError("try again")
    return json.dumps({"resultSets": [{"name": "S", "headers": ["ENDPOINT", "YEAR"], "rowSet": [[endpoint, year]]}]})


def sometimes(endpoint: str, year: int) -> str:
    if endpoint == "nothing":
        return json.dumps({"resultSets": []})
    return json.dumps({"resultSets": [{"name": "S", "headers": ["YEAR"], "rowSet": [[year]]}]})
