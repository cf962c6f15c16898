"""Limited-memory BFGS for the small models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """The point that ``loss`` (value and gradient) leads to from start; the same each time."""
    x = start.astype(float)
    value, grad = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < tolerance:
            break
        step, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = s @ step / (s @ y)
            step -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            step += (a - y @ step / (s @ y)) * s
        rate, slope = (1.0 if moves else min(1.0, 1 / np.linalg.norm(step))), grad @ step
        for _ in range(30):
            new, new_grad = loss(x - rate * step)
            if new <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = -rate * step, new_grad - grad
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-memory:]
        done = value - new < tolerance * max(1.0, abs(value))
        x, value, grad = x + s, new, new_grad
        if done:
            break
    return x
