"""Small logistic regressions fitted on a bounded sample of rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, n_features: int, ridge: float = 1e-3, pairs=None, pair_weight: float = 0.0, rounds: int = 300):
    """Weights and intercept of a logistic regression on sparse features.

    Entry ``e`` puts ``values[e]`` at ``(rows[e], columns[e])``.  ``pairs`` holds such entries of differences
    between a row and its counterpart; ``pair_weight`` penalises the mean square of the score change they
    make.  Gradient steps with momentum, scaled by a bound of each feature's curvature.
    """
    n = max(1, len(labels))
    weights, bias = np.zeros(n_features), 0.0
    curve = np.bincount(columns, values * values, minlength=n_features) / (4 * n) + ridge
    if pairs is not None and len(pairs[0]):
        p_rows, p_columns, p_values = pairs
        n_pairs = int(p_rows.max()) + 1
        curve += 2 * pair_weight * np.bincount(p_columns, p_values * p_values, minlength=n_features) / n_pairs
    else:
        pairs = None
    # Features overlap: a step of one over the mean number of active features keeps the descent stable.
    active = max(1.0, np.bincount(rows, minlength=n).mean()) if len(rows) else 1.0
    step = 1 / (curve * active)
    speed, bias_speed = np.zeros(n_features), 0.0
    for _ in range(rounds):
        ahead, ahead_bias = weights + 0.9 * speed, bias + 0.9 * bias_speed
        score = np.bincount(rows, values * ahead[columns], minlength=n) + ahead_bias
        error = sigmoid(score) - labels
        slope = np.bincount(columns, values * error[rows], minlength=n_features) / n + ridge * ahead
        if pairs is not None:
            change = np.bincount(p_rows, p_values * ahead[p_columns], minlength=n_pairs)
            slope += 2 * pair_weight * np.bincount(p_columns, p_values * change[p_rows], minlength=n_features) / n_pairs
        speed = 0.9 * speed - step * slope
        bias_speed = 0.9 * bias_speed - error.mean() * 4 / active
        weights, bias = weights + speed, bias + bias_speed
    return weights, bias
