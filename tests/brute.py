"""Plain-Python answers for small inputs."""

import numpy as np


def record(y, p, ids, threshold=0.5):
    y, p, ids = np.asarray(y), np.asarray(p, float), np.asarray(ids)
    n, pos = len(y), int(y.sum())
    out = {"n": n, "events": pos, "brier": float(np.mean((p - y) ** 2)), "mean_score": float(p.mean())}
    if 0 < pos < n:
        a, b = p[y == 1][:, None], p[y == 0][None, :]
        out["auroc"] = float(((a > b) + 0.5 * (a == b)).mean())
        out["auprc"] = sum(
            (y[p == s].sum() / pos) * (y[p >= s].sum() / (p >= s).sum()) for s in np.unique(p)
        )
    else:
        out["auroc"] = out["auprc"] = None
    k = max(1, n // 10)
    top = sorted(range(n), key=lambda i: (-p[i], ids[i]))[:k]
    hit = int(sum(y[i] for i in top))
    out["lift_top_decile"] = hit * n / (k * pos) if pos else 0.0
    out["capture_top_decile"] = hit / pos if pos else 0.0
    srt = np.sort(p)
    edges = []
    for j in range(1, 10):
        lo, rest = divmod(j * (n - 1), 10)
        hi = lo + (1 if rest else 0)
        edges.append(srt[lo] + (srt[hi] - srt[lo]) * (rest / 10))
    bins = (np.asarray(edges)[None, :] < p[:, None]).sum(1)
    out["mace"] = float(np.mean([abs(y[bins == b].mean() - p[bins == b].mean()) for b in np.unique(bins)]))
    flagged = p >= threshold
    out["tp"], out["fp"] = int((flagged & (y == 1)).sum()), int((flagged & (y == 0)).sum())
    out["fn"], out["tn"] = int((~flagged & (y == 1)).sum()), int((~flagged & (y == 0)).sum())
    return out


def tiles(n, t):
    """Tile of each 1-based rank."""
    big, size = n % t, n // t
    sizes = [size + 1] * big + [size] * (t - big)
    return [i + 1 for i, s in enumerate(sizes) for _ in range(s)]
