"""The slot and event rules over plain Python rows, written as plainly as possible."""

from __future__ import annotations

from datetime import date
from itertools import groupby

APPROVED = date(2021, 1, 22)


def sequence(rows, fields, template, numbers):
    """Slots of a subject in order: by number, then by row."""
    out = []
    for i in numbers:
        for row in sorted(rows, key=lambda r: r["row_id"]):
            out.append((i, row["row_id"], *[row[template.format(index=i, field=f)] for f in fields]))
    return out


def slot_rules(rows, as_of, shots, loads):
    """(rule, row, slot) for V27-V31 and V34-V37 of one subject."""
    found = set()
    previous = None
    for i, row, day, result in sequence(rows, ("date", "result"), "vl_{index}_{field}", loads):
        if previous and day and previous[2] and day < previous[2]:
            found.add(("V27", row, i))
        if result is None and day:
            found.add(("V28", row, i))
        if day and day > as_of:
            found.add(("V29", row, i))
        previous = (i, row, day)
    previous = None
    for i, row, day, dose in sequence(rows, ("date", "dose"), "shot{index}_{field}", shots):
        if previous and day and previous[2]:
            gap = (day - previous[2]).days
            if gap <= 0:
                found.add(("V30", row, i))
            if dose not in ("4", "5", "6"):
                code = previous[3]
                if previous[0] == 1 and code is not None and code != "6" or code in ("1", "3", "4", "5"):
                    low, high = 24, 38
                elif code in ("2", "6"):
                    low, high = 55, 69
                elif code is None:
                    low, high = 24, 69
                else:
                    low, high = -10**9, 10**9
                if gap > high:
                    found.add(("V34", row, i))
                if gap < low:
                    found.add(("V35", row, i))
        if dose is None and day:
            found.add(("V31", row, i))
        if day and day > as_of:
            found.add(("V36", row, i))
        if day and day < APPROVED:
            found.add(("V37", row, i))
        previous = (i, row, day, dose)
    return found


def subject_rules(rows, as_of, mode, numbers=(1, 2)):
    """Rule ids among V38-V51 that one subject breaks."""
    rows = sorted(rows, key=lambda r: r["row_id"])
    events = []
    for row in rows:
        for event in ("counsel", "screen"):
            for i in numbers:
                day, outcome = row[f"{event}_{i}_date"], row[f"{event}_{i}_outcome"]
                start = row["shot1_date"]
                if start is None or day is None or day <= start:
                    events.append({**row, "event": event, "i": i, "day": day, "outcome": outcome})
    if not events:
        return set()
    found = set()
    for event, ever, first, before, despite, wanted, extreme in (
        ("counsel", "V38", "V40", "V42", "V46", "3", "V48"),
        ("screen", "V39", "V41", "V43", "V45", "1", "V49"),
    ):
        mine = [e for e in events if e["event"] == event]
        some = any(e["day"] or e["outcome"] for e in mine)
        full = any(e["day"] and e["outcome"] for e in mine)
        codes = {e[f"{event}_ever"] for e in events}
        if not (codes == {"1"} and some or codes == {"0"} and not full or codes == {None} and not full):
            found.add(ever)
        if full and not any(e["i"] == 1 and (e["day"] or e["outcome"]) for e in mine):
            found.add(first)

        def after(e, event=event):
            if e["rx"] == "1" and e["event"] == event and e["day"] and e["rx_date"]:
                return 1 if e["day"] <= e["rx_date"] else 0
            return 1 if e["rx"] in ("0", None) and e["rx_date"] is None else None

        def agrees(e, event=event, wanted=wanted):
            if e["rx"] == "1" and e["event"] == event and e["outcome"] is not None:
                return 1 if e["outcome"] == wanted else 0
            return None

        flags = [after(e) for e in events]
        if mode == "default":
            flags = [f for f in flags if f is not None]
        if flags and all(f == 0 for f in flags):
            found.add(before)
        ordered = sorted(events, key=lambda e: (e["day"] is None, e["day"] or date.min))
        if mode == "default":
            ordered = [e for e in ordered if e["event"] == event and e["day"] and e["outcome"] is not None]
        if ordered and agrees(ordered[-1]) == 0:
            found.add(despite)
        if any(e["day"] and (e["day"] > as_of or e["day"] < APPROVED) for e in mine):
            found.add(extreme)
    for e in events:
        for rule, name in (("V50", "rx_date"), ("V51", "discontinued_date")):
            if e[name] and (e[name] > as_of or e[name] < APPROVED):
                found.add(rule)
    for row in rows:
        rx, day, start = row["rx"], row["rx_date"], row["shot1_date"]
        fine = rx == "1" and (start is None or day is None or start >= day) or rx in ("0", None) and day is None
        if not fine:
            found.add("V44")
        code, end = row["discontinued"], row["discontinued_date"]
        fine = (
            code is None
            or code == "1" and (end is None or day is not None and end >= day)
            or code == "0" and any((day, start, row["shot2_date"]))
        )
        if not fine:
            found.add("V47")
    return found


def by_subject(rows):
    rows = sorted(rows, key=lambda r: r["subject_id"])
    return {k: list(g) for k, g in groupby(rows, key=lambda r: r["subject_id"])}
