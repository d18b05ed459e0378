"""The research cadence as a stream: tier with hysteresis, spend of the month and next run, carried from tick to tick by site.

A tick is one pass of the loop over a site, with its number, the newest closed day, the mean visitors of the last closed days and the lifetime spend. The value state of a
site holds what the walk needs: level, days below and the day that was counted last, month and its anchor of the spend, and ticks that came before their
turn. So a tick that comes again changes nothing, ticks may be split into batches in any way, and one that comes early waits until those before it are there.

Up at once; down only after two closed days in a row below. A tick of a day that was counted already isn't counted again. Over the month's budget the slowest tier is
published, but the level stays what traffic has earned. A lifetime spend that goes backwards counts as nothing spent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ability_engine.operators.ingest import TIERS

PATIENCE = 2
TICKS = "site string, tick long, day date, mean double, usage double, budget double, last_research timestamp, at timestamp"
CADENCE = "site string, tick long, level int, tier string, interval_hours int, visitors_per_day double, month_usd double, capped boolean, next_research timestamp"
STATE = "last long, level int, below int, below_day string, month string, anchor double, early string"
START = (0, 0, 0, "", "", 0.0, "[]")


def target_level(mean: float) -> int:
    """Place of the tier that so many visitors a day call for."""
    return max(k for k, (_, least, _) in enumerate(TIERS) if k == 0 or mean >= least)


def step(state: tuple, tick: dict) -> tuple[tuple, dict]:
    """The state after a tick, and the cadence that it publishes. state: level, below, below_day, month, anchor."""
    level, below, below_day, month, anchor = state
    target, day = target_level(tick["mean"]), tick["day"]
    if target >= level:
        level, below, below_day = target, 0, ""
    elif day and day != below_day:
        below, below_day = below + 1, day
        if below >= PATIENCE:
            level, below, below_day = target, 0, ""
    now = datetime.fromtimestamp(tick["at"], UTC).strftime("%Y-%m")
    if now != month:
        month, anchor = now, tick["usage"]
    spent = max(0.0, tick["usage"] - anchor)
    capped = tick["budget"] > 0 and spent >= tick["budget"]
    name, _, hours = TIERS[0 if capped else level]
    due = None if tick["last_research"] is None else tick["last_research"] + hours * 3600
    out = {"level": level, "tier": name, "interval_hours": hours, "visitors_per_day": tick["mean"], "month_usd": spent, "capped": capped, "next_research": due}
    return (level, below, below_day, month, anchor), out


def _seconds(x) -> float | None:
    return None if pd.isna(x) else pd.Timestamp(x).tz_localize("UTC").timestamp() if pd.Timestamp(x).tzinfo is None else pd.Timestamp(x).timestamp()


def _ticks(part: pd.DataFrame) -> Iterator[dict]:
    for r in part.itertuples(index=False):
        day = "" if pd.isna(r.day) else str(r.day)[:10]
        yield {"tick": int(r.tick), "day": day, "mean": float(r.mean), "usage": 0.0 if pd.isna(r.usage) else float(r.usage), "budget": 0.0 if pd.isna(r.budget) else float(r.budget), "last_research": _seconds(r.last_research), "at": _seconds(r.at)}


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Walk on from the state by every tick whose turn it is. Ticks of a site are numbered from 1 without gaps."""
    last, *walked, early = state.get if state.exists else START
    waiting = {t["tick"]: t for t in json.loads(early)}
    for part in parts:
        waiting |= {t["tick"]: t for t in _ticks(part) if t["tick"] > last}
    rows = []
    while last + 1 in waiting:
        last += 1
        walked, out = step(tuple(walked), waiting.pop(last))
        rows.append({"site": key[0], "tick": last, **out})
    state.update((last, *walked, json.dumps(sorted(waiting.values(), key=lambda t: t["tick"]))))
    names = [c.split()[0] for c in CADENCE.split(", ")]
    found = pd.DataFrame(rows, columns=names)
    found["next_research"] = pd.to_datetime(found["next_research"], unit="s")
    yield found


def cadence(ticks: DataFrame) -> DataFrame:
    """The cadence that each tick of a stream (TICKS) publishes, in append mode."""
    return ticks.groupBy("site").applyInPandasWithState(advance, CADENCE, STATE, "append", GroupStateTimeout.NoTimeout)


def walk(ticks: list[dict]) -> list[dict]:
    """The same, one tick after another: for tests and single sites. ticks: as ``TICKS``, with numbers of seconds for times and text for days."""
    state, out = START[1:6], []
    for t in sorted(ticks, key=lambda t: t["tick"]):
        state, row = step(state, t)
        out.append(row)
    return out
