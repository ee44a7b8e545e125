"""Seasonal ARIMA with regressors by conditional least squares, all folds of a series in one pass.

The small numeric helper behind ``operators.arima``. Folds are the rows of a matrix aligned at their last
month, so that differencing, filtering and the Levenberg-Marquardt steps run on all folds together.
Coefficients are searched as partial autocorrelations through tanh, which keeps every fit stationary and
invertible. Spark decides which series and configurations meet here.
"""

from __future__ import annotations

import numpy as np

SEASON = 12
GUERRERO = np.round(np.arange(-0.9, 2.0001, 0.05), 2)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials in the last axis."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]) + (a.shape[-1] + b.shape[-1] - 1,))
    for i in range(b.shape[-1]):
        out[..., i:i + a.shape[-1]] += a * b[..., i:i + 1]
    return out


def _polynomial(z: np.ndarray, step: int, sign: float) -> np.ndarray:
    """1 + sign * (c1 B^step + c2 B^2step + ...) with c from partial autocorrelations tanh(z)."""
    partial, order = np.tanh(z), z.shape[-1]
    c = np.zeros_like(partial)
    for k in range(order):
        past, last = c[..., :k].copy(), partial[..., k:k + 1]
        c[..., :k] = past - last * past[..., ::-1]
        c[..., k:k + 1] = last
    out = np.zeros(z.shape[:-1] + (order * step + 1,))
    out[..., 0] = 1
    out[..., step::step] = sign * c
    return out


def _difference(d: int, seasonal_d: int) -> np.ndarray:
    out = np.ones(1)
    for step in [1] * d + [SEASON] * seasonal_d:
        factor = np.zeros(step + 1)
        factor[0], factor[step] = 1, -1
        out = np.convolve(out, factor)
    return out


def _filter(poly: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Apply a lag polynomial along the last axis; what lies before the first column counts as zero."""
    out = poly[..., :1] * rows
    for lag in range(1, min(poly.shape[-1], rows.shape[-1])):
        if np.any(poly[..., lag]):
            out[..., lag:] += poly[..., lag:lag + 1] * rows[..., :-lag]
    return out


def boxcox(y: np.ndarray, lam: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        safe = np.where(lam == 0, 1, lam)
        return np.where(lam == 0, np.log(y), (np.power(y, safe) - 1) / safe)


def inverse_boxcox(z: np.ndarray, lam: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        safe = np.where(lam == 0, 1, lam)
        return np.where(lam == 0, np.exp(z), np.power(z * safe + 1, 1 / safe))


def guerrero(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lambda of each fold by the whole seasons before its origin; 1 where that is undefined."""
    blocks = rows.shape[1] // SEASON
    if blocks < 2:
        return np.ones(len(rows))
    seasons = rows[:, rows.shape[1] - blocks * SEASON:].reshape(len(rows), blocks, SEASON)
    whole = np.arange(blocks)[::-1] < (lengths // SEASON)[:, None]
    mean, sd = seasons.mean(axis=2), seasons.std(axis=2, ddof=1)
    with np.errstate(all="ignore"):
        ratio = sd[..., None] / np.power(mean[..., None], 1 - GUERRERO)
        count = whole.sum(axis=1)[:, None]
        ratio = np.where(whole[..., None], ratio, 0)
        centre = ratio.sum(axis=1) / count
        square = np.where(whole[..., None], (ratio - centre[:, None]) ** 2, 0).sum(axis=1)
        variation = np.sqrt(square / (count - 1)) / centre
    variation = np.where(np.isfinite(variation), variation, np.inf)
    usable = (count[:, 0] >= 2) & (np.where(whole[..., None], seasons, 1) > 0).all(axis=(1, 2))
    usable &= np.isfinite(variation).any(axis=1)
    return np.where(usable, GUERRERO[variation.argmin(axis=1)], 1.0)


def fill_gaps(y: np.ndarray) -> np.ndarray:
    """Missing months take the value a season earlier, else the month before: never a later one."""
    y = y.copy()
    for t in np.flatnonzero(np.isnan(y)):
        if t >= SEASON and not np.isnan(y[t - SEASON]):
            y[t] = y[t - SEASON]
        elif t >= 1:
            y[t] = y[t - 1]
    return y


def fit(y: np.ndarray, x: np.ndarray | None, origins: np.ndarray, h: int, *, w: int | None = None,
        l: str | None = None, dr: bool = False, p: int = 0, d: int = 0, q: int = 0,  # noqa: E741
        ps: int = 0, ds: int = 0, qs: int = 0, skip: int | None = None,
        quantiles: tuple[float, ...] = (), steps: int = 60) -> dict[str, np.ndarray]:
    """Fit each origin's training part and forecast ``h`` months.

    Returns ``yhat`` (folds, h), its ``bounds`` (folds, quantiles, h) at the normal ``quantiles``, the
    weights ``psi`` (folds, h), and per fold ``sigma2``, ``n_obs``, ``aicc`` and the one-step ``fitted``
    values aligned at the origin; NaN where a fold cannot be fitted. Forecast and bounds are transformed
    back. ``skip`` leaves the first months of every fold out of the score, so that configurations with
    different differencing are scored on the same months. ``converged`` tells whether the search ended before
    its last of ``steps``.
    """
    n, folds = len(y), len(origins)
    filled = fill_gaps(np.asarray(y, float))
    known = np.flatnonzero(~np.isnan(filled))
    start = np.ones(folds, int) if w is None else origins - w + 1
    start = np.maximum(start, known[0] + 1 if len(known) else n + 1)
    lengths = origins - start + 1
    width = max(int(lengths.max()), 1)
    months = origins[:, None] - width + 1 + np.arange(width + h)
    inside = months[:, :width] >= start[:, None]
    raw = np.where(inside, filled[np.clip(months[:, :width] - 1, 0, n - 1)], 1.0)
    lam = None
    if l is not None:
        lam = (guerrero(raw, lengths) if l == "auto" else np.full(folds, float(l)))[:, None]
        raw = boxcox(raw, lam)
    # Each fold by its own spread, so that the search takes the same steps whichever folds stand beside it.
    usable = inside & np.isfinite(raw)
    count = np.maximum(usable.sum(axis=1), 1)
    centred = np.where(usable, raw - (np.where(usable, raw, 0.0).sum(axis=1) / count)[:, None], 0.0)
    scale = np.sqrt((centred ** 2).sum(axis=1) / count)
    scale = np.where(scale > 0, scale, 1.0)
    rows = np.where(inside, raw / scale[:, None], 0.0)

    columns = []
    if d + ds == 0:
        columns.append(np.ones(months.shape))
    if dr and d + ds <= 1:
        columns.append(months / n)
    for one in () if x is None else np.reshape(x, (len(x), -1)).T:  # a column for each regressor
        known = np.where((months >= 1) & (months <= len(one)), one[np.clip(months - 1, 0, len(one) - 1)], np.nan)
        given = one[~np.isnan(one)]
        centre, spread = (given.mean(), given.std() or 1.0) if len(given) else (0.0, 1.0)
        columns.append((known - centre) / spread)
    design = np.stack(columns, axis=2) if columns else np.zeros(months.shape + (0,))
    before = np.where(inside[..., None], design[:, :width], 0.0)

    diff = _difference(d, ds)
    lost = d + SEASON * ds
    dw = _filter(diff, rows)
    dx = _filter(diff, before.transpose(0, 2, 1))
    first = width - lengths + lost + p + SEASON * ps
    used = np.arange(width) >= first[:, None]
    n_beta, n_par = design.shape[2], design.shape[2] + p + q + ps + qs
    n_obs = used.sum(axis=1)
    ok = (n_obs > n_par + 1) & np.isfinite(rows).all(axis=1) & np.isfinite(before).all(axis=(1, 2))
    dw, dx = np.where(ok[:, None], dw, 0.0), np.where(ok[:, None, None], dx, 0.0)

    cuts = np.cumsum([n_beta, p, q, ps, qs])[:-1]

    def parts(par: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        beta, zp, zq, zps, zqs = np.split(par, cuts, axis=-1)
        ar = _multiply(_polynomial(zp, 1, -1.0), _polynomial(zps, SEASON, -1.0))
        ma = _multiply(_polynomial(zq, 1, 1.0), _polynomial(zqs, SEASON, 1.0))
        return beta, ar, ma

    def residuals(par: np.ndarray) -> np.ndarray:
        """(folds, variants, months) for parameters (folds, variants, n_par)."""
        beta, ar, ma = parts(par)
        noise = dw[:, None, :] - beta @ dx
        e = np.where(used[:, None, :], _filter(ar, noise), 0.0)
        lags = [k for k in range(1, ma.shape[-1]) if np.any(ma[..., k])]
        if lags:
            for t in range(int(first.min()), width):
                for k in lags:
                    if k <= t:
                        e[..., t] -= ma[..., k] * e[..., t - k]
                e[..., t] *= used[:, None, t]
        return e

    par = np.zeros((folds, n_par))
    with np.errstate(all="ignore"):
        if n_beta:
            m = np.where(used[:, None, :], dx, 0.0)
            inverse = np.linalg.pinv(m.transpose(0, 2, 1), rcond=1e-10)
            par[:, :n_beta] = (inverse @ dw[..., None])[..., 0]
        e = residuals(par[:, None, :])[:, 0]
        sse, damping, eps = (e * e).sum(axis=1), np.full(folds, 1e-3), 1e-5
        searching = ok & (n_par > n_beta)  # a plain regression is solved already
        for _ in range(steps):
            if not searching.any():
                break
            moved = par[:, None, :] + eps * np.eye(n_par)
            jac = (residuals(moved) - e[:, None, :]) / eps
            gram = jac @ jac.transpose(0, 2, 1)
            diagonal = np.einsum("fkk->fk", gram)
            gram = gram + (damping[:, None] * diagonal + 1e-12)[:, :, None] * np.eye(n_par)
            step = np.linalg.solve(np.nan_to_num(gram) + 1e-12 * np.eye(n_par),
                                   np.nan_to_num(jac @ e[..., None]))[..., 0]
            trial = par - np.clip(step, -1.5, 1.5)
            trial[:, n_beta:] = np.clip(trial[:, n_beta:], -3.5, 3.5)
            e_trial = residuals(trial[:, None, :])[:, 0]
            sse_trial = (e_trial * e_trial).sum(axis=1)
            better = searching & (sse_trial < sse)
            gain = np.where(better, (sse - sse_trial) / np.maximum(sse, 1e-300), 0.0)
            par[better], e[better], sse[better] = trial[better], e_trial[better], sse_trial[better]
            damping = np.clip(np.where(better, damping / 4, damping * 5), 1e-9, 1e9)
            # Each fold stops for itself, so its numbers don't depend on those that share its block.
            searching = searching & ~((gain < 1e-7) & (better | (damping > 1e3)))

        beta, ar, ma = parts(par[:, None, :])
        beta, ar, ma = beta[:, 0], ar[:, 0], ma[:, 0]
        full = _multiply(ar, np.broadcast_to(diff, (folds, len(diff))))
        level = np.concatenate([rows - np.einsum("fwm,fm->fw", before, beta), np.zeros((folds, h))], axis=1)
        shock = np.concatenate([e, np.zeros((folds, h))], axis=1)
        psi = np.zeros((folds, h))
        for k in range(h):
            t = width + k
            for lag in range(1, min(full.shape[1], t + 1)):
                level[:, t] -= full[:, lag] * level[:, t - lag]
            for lag in range(k + 1, ma.shape[1]):
                if lag <= t:
                    level[:, t] += ma[:, lag] * shock[:, t - lag]
            psi[:, k] = ma[:, k] if k < ma.shape[1] else 0.0
            for lag in range(1, min(full.shape[1], k + 1)):
                psi[:, k] -= full[:, lag] * psi[:, k - lag]
        yhat = (level[:, width:] + np.einsum("fhm,fm->fh", design[:, width:], beta)) * scale[:, None]
        fitted = np.where(used, (rows - e) * scale[:, None], np.nan)
        sigma2 = sse / np.maximum(n_obs - n_par, 1) * scale ** 2
        sd = np.sqrt(sigma2[:, None] * np.cumsum(psi ** 2, axis=1))
        bounds = yhat[:, None, :] + np.reshape(quantiles, (1, -1, 1)) * sd[:, None, :]
        scored = np.arange(width) >= (first if skip is None else width - lengths + skip)[:, None]
        scored &= used
        m, k = scored.sum(axis=1), n_par + 1
        loss = (np.where(scored, e, 0.0) ** 2).sum(axis=1) / m * scale ** 2
        aicc = m * np.log(loss) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
        aicc = np.where(m - k - 1 > 0, aicc, np.nan)
        if lam is not None:
            original = filled[np.clip(months[:, :width] - 1, 0, n - 1)]
            aicc = aicc - 2 * (lam[:, 0] - 1) * np.where(scored, np.log(original), 0.0).sum(axis=1)
            yhat, fitted = inverse_boxcox(yhat, lam), inverse_boxcox(fitted, lam)
            bounds = inverse_boxcox(bounds, lam[:, :, None])
    blank = lambda a: np.where(ok.reshape((-1,) + (1,) * (a.ndim - 1)) & np.isfinite(a), a, np.nan)
    return {"yhat": blank(yhat), "bounds": blank(bounds), "psi": blank(psi), "sigma2": blank(sigma2), "aicc": blank(aicc),
            "fitted": blank(fitted), "n_obs": np.where(ok, n_obs, 0),
            "converged": ok & ~searching}
