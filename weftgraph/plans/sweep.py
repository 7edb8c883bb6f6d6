"""Parameter sweeps: partition, measure, one row of metrics each."""

from __future__ import annotations

import itertools
import time

from .. import quality
from ..graph import Graph
from ..operators import lp, samplers


def sweep(g: Graph, ks=(4, 8), samplings=("RD",), betas=(0.1,), sigmas=(0.01,), taus=(5,), mode: str = "edge", seed: int = 1, max_iterations: int = 290) -> list[dict]:
    out = []
    for k, kind, beta, sigma, tau in itertools.product(ks, samplings, betas, sigmas, taus):
        t0 = time.time()
        start, rounds = (None, []) if kind in (None, "HUBS") else samplers.sample(g, kind, k, beta, sigma, tau, seed)
        t1 = time.time()
        labels, history = lp.run(g, lp.Settings(k=k, mode=mode, seed=seed, max_iterations=max_iterations), start)
        t2 = time.time()
        row = quality.summary(g, labels, k).first().asDict()
        out.append(row | {"k": k, "sampler": kind, "beta": beta, "sigma": sigma, "tau": tau, "sampling_rounds": len(rounds), "lp_cycles": len(history), "migrations": sum(h["migrations"] for h in history), "sampling_s": t1 - t0, "lp_s": t2 - t1})
    return out
