"""Snapshot rows recomputed per user and day straight from the definitions (pandas)."""

import datetime as dt

import pandas as pd


def _window(history, d, k):
    return history[(history["date"] > d - dt.timedelta(days=k)) & (history["date"] <= d)]


def _ratio(a, b):
    return a / b if b > 0 else 0.0


def snapshot_row(history, d, vocabulary):
    last = history.iloc[-1]
    w = {k: _window(history, d, k) for k in (3, 7, 30)}
    bought = {k: int((x["event_type"] == "purchase").sum()) for k, x in w.items()}
    spent = {k: x["price"].sum() for k, x in w.items()}
    purchases = int((history["event_type"] == "purchase").sum())
    total_spent, days = history["price"].sum(), history["date"].nunique()
    idle = (d - last["date"]).days
    row = {
        "snapshot_date": d,
        "user_id": last["user_id"],
        "total_events": len(history),
        "unique_days": days,
        "total_clicks": int((history["event_type"] == "click").sum()),
        "total_purchases": purchases,
        "total_spent": total_spent,
        "distinct_items": history["item_id"].dropna().nunique(),
        "events_last_7d": len(w[7]),
        "events_last_30d": len(w[30]),
        "purchases_last_30d": bought[30],
        "spent_last_30d": spent[30],
        "conversion_rate_30d": bought[30] / max(1, len(w[30])),
        "avg_order_value_30d": spent[30] / max(1, bought[30]),
        "purchase_frequency": purchases / max(1, days),
        "avg_spend_per_event": total_spent / len(history),
        "days_since_first": (d - history["date"].iloc[0]).days,
        "days_since_last": idle,
        "events_per_day": len(history) / max(1, days),
        "recency_score": 1 / (1 + idle),
        "last_event_type": last["event_type"],
        "last_region": last["region"],
        "last_item": last["item_id"],
        "micro_event_growth": _ratio(len(w[3]), len(w[7])),
        "micro_purchase_growth": _ratio(bought[3], bought[7]),
        "micro_purchase_ratio": _ratio(bought[3], len(w[3])),
        "micro_spent_growth": _ratio(spent[3], spent[7]),
    }
    recent = history["event_type"].iloc[-50:]
    known = recent[recent.isin(vocabulary)]
    for i, name in enumerate(vocabulary):
        row[f"seq_emb_{i}"] = _ratio(int((known == name).sum()), len(known))
    return row


def _targets(events, d, horizon):
    later = events[(events["event_type"] == "purchase") & (events["date"] > d)]
    if len(later):
        first = later.iloc[0]
        delta = (first["date"] - d).days
        if delta <= horizon:
            return {"will_purchase_next_7d": 1, "days_to_next_purchase": delta, "next_purchase_amount": first["price"]}
    return {"will_purchase_next_7d": 0, "days_to_next_purchase": 999, "next_purchase_amount": 0.0}


def _ordered(events):
    events = events.sort_values(["ts", "event_id"], kind="stable")
    vocabulary = list(dict.fromkeys(events["event_type"].dropna()))
    return events, vocabulary


def training(events, horizon=7):
    events, vocabulary = _ordered(events)
    dates = sorted(events["date"].unique())
    rows = []
    for _, own in events.groupby("user_id"):
        for d in dates:
            if own["date"].iloc[0] <= d <= dates[-1] - dt.timedelta(days=horizon):
                history = own[own["date"] <= d]
                rows.append({**snapshot_row(history, d, vocabulary), **_targets(own, d, horizon)})
    return pd.DataFrame(rows)


def daily(events):
    events, vocabulary = _ordered(events)
    today = events["date"].max()
    return pd.DataFrame([snapshot_row(own, today, vocabulary) for _, own in events.groupby("user_id")])
