"""A row plugin: how far the number in an event's properties is from its value. Pinned in `runs.py` by its SHA-256."""

import json

PLUGIN_ID = "margin"
PLUGIN_VERSION = "1.0.0"


def evaluate(event_id, value, props):
    if value > 150:
        raise ValueError("value out of range")
    k = json.loads(props)["k"]
    return {"k": k, "over": k > value, "margin": k - int(value // 1)}
