"""The tracker's plain-float path against its array path."""

import random

import pytest

from boxweave.operators import tracking as T


def played(seed, config):
    rng, tracker, out = random.Random(seed), T.Tracker(config, 640.0, 480.0), []
    for n in range(300):
        seen = []
        for _ in range(rng.randrange(0, 9)):
            x, y, k = 40.0 * rng.randrange(8), 30.0 * rng.randrange(8), rng.randrange(3)
            w, h = rng.choice([0.0, 30.0, 44.0, 97.3, -2.0]), rng.choice([0.0, 33.0, 61.7])
            seen.append(T.Seen([x, y, x + w, y + h], k, f"c{k}", rng.choice([0.25, 0.5, 0.9])))
        update = tracker.update(40 * n, seen)
        out.append(repr((update.shown, update.motion, update.matched, update.created, update.lost)))
    return out


@pytest.mark.parametrize("config", [T.TrackerConfig(), T.TrackerConfig(confirm_hits=1, reversal_damping=True, global_motion=True)])
def test_both_paths_give_the_same_bits(monkeypatch, config):
    few = [played(seed, config) for seed in range(6)]
    monkeypatch.setattr(T, "SMALL", -1)
    assert few == [played(seed, config) for seed in range(6)]


def test_a_small_frame_makes_no_arrays(monkeypatch):
    monkeypatch.setattr(T, "_measures", None)
    tracker = T.Tracker(T.TrackerConfig(), 640.0, 480.0)
    for n in range(3):
        update = tracker.update(33 * n, [T.Seen([0.0, 0.0, 40.0, 30.0 + n], 1, "cup", 0.5)])
    assert update.matched == 1
