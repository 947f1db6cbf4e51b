"""A small synthetic three-wave survey with known structure, written as CSV."""

import csv

import numpy as np


def write_waves(folder, n=1500, seed=7, log_rr=0.25):
    rng = np.random.default_rng(seed)
    ids = [f"u{i:05d}" for i in range(n)]
    age = rng.integers(20, 85, n)
    sex = rng.integers(1, 3, n)
    smoke = rng.integers(1, 6, n)
    gap = lambda: rng.random(n) < 0.04
    one = {
        "USER_ID": ids, "SEX": sex, "AGE": age, "Q12": rng.integers(1, 7, n), "Q10": rng.integers(1, 15, n),
        "Q7.1": rng.integers(1, 5, n), "Q17.7": rng.integers(1, 6, n), "Q9": smoke, "Q41": rng.integers(1, 8, n),
        "Q42": rng.integers(1, 6, n), "Q25.4": rng.integers(1, 6, n), "Q25.7": rng.integers(1, 4, n),
        "Q34.3": rng.integers(1, 3, n), "Q78": rng.integers(1, 6, n), "Q83.1": rng.normal(165, 8, n).round(1),
        "Q83.2": rng.normal(62, 10, n).round(1),
    }
    stay2 = rng.random(n) < 1 / (1 + np.exp(-(1.6 - 0.015 * (85 - age) - 0.3 * (smoke <= 2))))
    stay3 = stay2 & (rng.random(n) < 0.9)
    latent = rng.normal(0, 1, n) + 0.3 * (sex == 1)
    items = np.clip(np.round(2.5 + 0.6 * latent[:, None] + rng.normal(0, 0.7, (n, 13))), 1, 4).astype(int)
    two = {"USER_ID": ids}
    for i in range(13):
        two[f"Q32.{i + 1}"] = 5 - items[:, i] if 9 <= i + 1 <= 12 else items[:, i]
    score = items.sum(axis=1)
    z = (score - score.mean()) / score.std()
    three = {"USER_ID": ids}
    event = lambda base: (rng.random(n) < np.minimum(0.95, base * np.exp(log_rr * z + 0.01 * (age - 50)))).astype(int)
    three["Q91"] = np.where(event(0.15) == 1, 1, 2)
    for i in range(1, 5):
        pick = rng.choice([1, 2, 3, 4, 5], n, p=[0.05, 0.05, 0.05, 0.15, 0.7])
        for o in range(1, 6):
            three[f"Q23.{i}-{o}"] = (pick == o).astype(int)
    three["Q20"] = rng.integers(1, 10, n)
    three["Q37.10"] = rng.integers(1, 3, n)
    for i in (1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18):
        three[f"Q89_{i}"] = np.where(event(0.2) == 1, rng.integers(3, 6, n), rng.integers(1, 3, n))
    for i in (1, 2, 3, 4, 5, 6, 7, 9, 13, 14, 17, 18, 19, 20):
        three[f"Q26_{i}"] = np.where(event(0.2) == 1, rng.integers(3, 5, n), rng.integers(1, 3, n))
    paths = []
    for name, wave, keep in (("w1", one, np.ones(n, bool)), ("w2", two, stay2), ("w3", three, stay3)):
        path = f"{folder}/{name}.csv"
        holes = {c: gap() for c in wave if c != "USER_ID"}
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(wave)
            for r in np.flatnonzero(keep):
                out.writerow(["" if c != "USER_ID" and holes[c][r] else wave[c][r] for c in wave])
        paths.append(path)
    return paths
