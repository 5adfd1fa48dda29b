"""Spectral peaks and their pairs against plain sums of cosines and sines, and loops over all pairs."""

from __future__ import annotations

import cmath
import math

import numpy as np
import pytest

from loomgraph.llm import media


def plain_peaks(samples: bytes) -> list[tuple[int, int]]:
    found = []
    for t in range(-(-len(samples) // media.FRAME)):
        frame = [b - 128.0 for b in samples[t * media.FRAME : (t + 1) * media.FRAME]]
        frame += [0.0] * (media.FRAME - len(frame))
        mean = sum(frame) / media.FRAME
        shaped = [(x - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1))) for k, x in enumerate(frame)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * f * k / media.FRAME) for k, x in enumerate(shaped))) for f in range(media.FRAME // 2 + 1)]
        floor = media.LOUDNESS * sum(power) / len(power) + 1e-3
        for low, high in media.BANDS:
            loudest = max(range(low, high), key=lambda f: (power[f], -f))
            if power[loudest] > floor:
                found.append((t, loudest))
    return sorted(found)


def plain_pairs(peaks: list[tuple[int, int]]) -> list[int]:
    return sorted(t << 32 | f << 20 | g << 8 | u - t for t, f in peaks for u, g in peaks if 0 < u - t <= media.PAIR_FRAMES)


@pytest.mark.parametrize("seed", range(4))
def test_features_equal_plain_sums(seed):
    rng = np.random.default_rng(seed)
    tones = sum(rng.uniform(10, 40) * np.sin(2 * np.pi * f * np.arange(1700) / media.FRAME) for f in rng.integers(2, 120, 3))
    samples = {0: bytes(64), 1: b"the quick brown fox " * 70, 2: rng.integers(0, 256, 900).astype(np.uint8).tobytes()}.get(seed) or np.clip(128 + tones, 0, 255).astype(np.uint8).tobytes()
    times, bins, n_frames = media.spectral_peaks(samples)
    want = plain_peaks(samples)
    assert list(zip(times.tolist(), bins.tolist())) == want and n_frames == -(-len(samples) // media.FRAME)
    assert media.pair_fingerprints(times, bins).tolist() == plain_pairs(want)
    if seed in (1, 3):
        assert len(want) > 3
