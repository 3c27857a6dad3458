"""Plain loops saying what the distributed operators must give on small inputs."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np

from signalgraph.functions.scalars import PARAMETER_PATTERN


def ticks(rows, window, tick):
    """{(tick_no, service): rows} for ``rows`` of (ts, service, ...)."""
    out = defaultdict(list)
    last = math.floor(max(r[0] for r in rows) / tick) + 1
    for r in rows:
        pane = math.floor(r[0] / tick)
        for t in range(pane + 1, min(pane + int(window / tick), last) + 1):
            out[t, r[1]].append(r)
    return out


def quantile(values, p):
    return float(np.quantile(np.array(values, dtype=float), p))


def mine(messages, threshold, depth=4, children=100):
    """Template number of each message in order, and the final texts."""
    tree, groups, texts, out = {}, defaultdict(list), [], []
    for message in messages:
        words = re.sub(PARAMETER_PATTERN, "<*>", message).split()
        if not words:
            out.append(0)
            continue
        path = (len(words),)
        for w in words[:depth]:
            branch = "<*>" if w[0] == "<" else w
            known = tree.setdefault(path, [])
            if branch not in known:
                if len([b for b in known if b is not None]) < children:
                    known.append(branch)
                else:
                    branch = "<*>"
            path += (branch,)
        scores = [sum(x in (w, "<*>") for x, w in zip(texts[g], words)) / len(words) for g in groups[path]]
        if scores and max(scores) >= threshold:
            number = groups[path][scores.index(max(scores))]
            texts[number] = [x if x == w else "<*>" for x, w in zip(texts[number], words)]
        else:
            number = len(texts)
            texts.append(words)
            groups[path].append(number)
        out.append(number + 1)
    return out, [" ".join(t) for t in texts]


def edge_weights(calls, last_seq, decay, floor):
    """{(source, target, seq): weight} from {(source, target, seq): calls}, densely."""
    out, now = {}, {}
    for seq in range(1, last_seq + 1):
        now = {e: w * decay for e, w in now.items()}
        for (a, b, s), n in calls.items():
            if s == seq:
                now[a, b] = now.get((a, b), 0.0) + n
        now = {e: w for e, w in now.items() if w >= floor}
        out.update({(*e, seq): w for e, w in now.items()})
    return out


def incidents(anomalies, gap):
    """First anomaly of the incident of each, from (id, ts, service, blast) in order.
    An incident is the list of its anomalies so far; what it holds is read off them."""
    stories = []

    def fit(story, ts, service, blast):
        own = {s for _, _, s, _ in story}
        reach = {m for _, _, _, b in story for m in b} | own
        ties = 3 * (service in reach) + 4 * (service in own) + 2 * (not own.isdisjoint(blast))
        return ties and ties + max(0.0, 1 - (ts - story[-1][1]) / gap)

    for one in anomalies:
        _, ts, service, blast = one
        candidates = [x for x in stories if ts - x[-1][1] <= gap and fit(x, ts, service, blast)]
        if candidates:
            max(candidates, key=lambda x: fit(x, ts, service, blast)).append(one)
        else:
            stories.append([one])
    return {key: story[0][0] for story in stories for key, _, _, _ in story}


def depths(rows):
    """Depth of each (ts, span, service, parent) in order."""
    level, out = {}, []
    for _, _, service, parent in sorted(rows):
        d = level.get(parent, 0)
        level.setdefault(service, d + 1)
        out.append(d)
    return out


def firings(matching, seconds):
    """Ticks at which a rule fires, from {tick index: tick time} that match, in order."""
    out, entered, fired, before = [], None, False, None
    for index, at in sorted(matching.items()):
        if before is None or index != before + 1:
            entered, fired = at, False
        before = index
        if not fired and at - entered >= seconds:
            fired = True
            out.append(index)
    return out
