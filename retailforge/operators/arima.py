"""ARIMA per series (operators 122, 123, 121): exact likelihood, numpy only.

The numeric core runs inside ``groupBy(series).applyInPandas``: each call sees
one series (a few hundred months at most), never the line table.  The model
is the state-space form of an ARMA(p, q)·(P, Q)[s] with mean, started from
the stationary covariance (Lyapunov equation) and filtered by Kalman
recursions; σ² is concentrated out and the remaining parameters are found by
Nelder–Mead.  This is the exact Gaussian likelihood that ``arima`` maximises;
conditional sum of squares does not reproduce the published forecasts.
"""

from __future__ import annotations

import math

import numpy as np

Z80, Z95 = 1.2815515655446004, 1.959963984540054


def _poly_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.convolve(a, b)


def expand(phi, theta, sphi, stheta, s):
    """Full AR / MA coefficient vectors of (1-φB)(1-ΦB^s) and (1+θB)(1+ΘB^s)."""
    ar = np.r_[1.0, -np.asarray(phi, float)]
    if len(sphi):
        sp = np.zeros(s * len(sphi) + 1)
        sp[0] = 1.0
        sp[s::s] = -np.asarray(sphi, float)
        ar = _poly_mul(ar, sp)
    ma = np.r_[1.0, np.asarray(theta, float)]
    if len(stheta):
        sm = np.zeros(s * len(stheta) + 1)
        sm[0] = 1.0
        sm[s::s] = np.asarray(stheta, float)
        ma = _poly_mul(ma, sm)
    return -ar[1:], ma[1:]


def _stationary(coef: np.ndarray) -> bool:
    if len(coef) == 0 or not np.any(coef):
        return True
    roots = np.roots(np.r_[1.0, -coef][::-1])
    return bool(np.all(np.abs(roots) > 1.0 + 1e-8))


def _covariance(T: np.ndarray, RR: np.ndarray) -> np.ndarray:
    """Solution of P = T P T' + RR: directly for small systems, else by doubling the number of summed terms."""
    r = len(T)
    if r > 8:
        P, A = RR.copy(), T.copy()
        for _ in range(40):
            more = A @ P @ A.T
            P = P + more
            A = A @ A
            if np.abs(more).max() <= 1e-15 * np.abs(P).max():
                return P
    return np.linalg.solve(np.eye(r * r) - np.kron(T, T), RR.ravel()).reshape(r, r)


def _system(phi: np.ndarray, theta: np.ndarray):
    p, q = len(phi), len(theta)
    r = max(p, q + 1)
    T = np.zeros((r, r))
    T[:p, 0] = phi
    T[:-1, 1:] += np.eye(r - 1)
    R = np.zeros(r)
    R[0] = 1.0
    R[1:q + 1] = theta
    RR = np.outer(R, R)
    # stationary covariance: P = T P T' + R R'
    P0 = _covariance(T, RR)
    return T, RR, P0


def kalman(y: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """Innovations of a zero-mean ARMA: returns (ssq, sumlog, v, F, a, P) with a, P the n+1 prediction."""
    T, RR, P = _system(phi, theta)
    a = np.zeros(T.shape[0])
    n = len(y)
    v = np.empty(n)
    Fs = np.empty(n)
    steady = False
    for t in range(n):
        F = P[0, 0]
        e = y[t] - a[0]
        v[t], Fs[t] = e, F
        K = P[:, 0] / F
        a = T @ (a + K * e)
        if not steady:
            P_new = T @ (P - np.outer(K, P[0, :])) @ T.T + RR
            # once the filter has converged, gain and variance stay fixed
            steady = abs(P_new[0, 0] - F) <= 1e-13 * F and np.allclose(P_new, P, rtol=1e-13, atol=0)
            P = P_new
    ssq = float(np.sum(v * v / Fs))
    return ssq, float(np.sum(np.log(Fs))), v, Fs, a, P


def nelder_mead(f, x0, step=0.1, tol=1e-10, max_iter=5000):
    n = len(x0)
    pts = [np.asarray(x0, float)]
    for i in range(n):
        x = np.array(x0, float)
        x[i] += step if x[i] == 0 else step * max(1.0, abs(x[i]))
        pts.append(x)
    vals = [f(x) for x in pts]
    for _ in range(max_iter):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol) and \
                max(np.max(np.abs(p - pts[0])) for p in pts[1:]) < max(1e-9, tol * 10):
            break
        c = np.mean(pts[:-1], axis=0)
        xr = c + (c - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = c + 2 * (c - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = c + 0.5 * (pts[-1] - c) if fr >= vals[-1] else c + 0.5 * (xr - c)
            fc = f(xc)
            if fc < min(fr, vals[-1]):
                pts[-1], vals[-1] = xc, fc
            else:
                for i in range(1, len(pts)):
                    pts[i] = pts[0] + 0.5 * (pts[i] - pts[0])
                    vals[i] = f(pts[i])
    i = int(np.argmin(vals))
    return pts[i], vals[i]


class ArimaFit:
    def __init__(self, order, seasonal, period, coef, mu, sigma2, loglik, n, resid, a, P, phi, theta, sd,
                 npar):
        self.order, self.seasonal, self.period = order, seasonal, period
        self.coef, self.mu, self.sigma2, self.loglik, self.n = coef, mu, sigma2, loglik, n
        self.resid, self.a, self.P, self.phi, self.theta, self.sd = resid, a, P, phi, theta, sd
        self.npar = npar
        k = npar + 1
        self.aic = -2 * loglik + 2 * k
        self.aicc = self.aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf
        self.bic = -2 * loglik + math.log(n) * k

    def forecast(self, h: int, sigma2: float | None = None):
        """Point forecasts and 80/95 % bounds for steps 1..h."""
        s2 = self.sigma2 if sigma2 is None else sigma2
        T, RR, _ = _system(self.phi, self.theta)
        a, P = self.a.copy(), self.P.copy()
        out = []
        for _ in range(h):
            mean = a[0] * self.sd + self.mu
            se = math.sqrt(max(P[0, 0], 0.0) * s2)
            out.append((mean, mean - Z80 * se, mean + Z80 * se, mean - Z95 * se, mean + Z95 * se))
            a = T @ a
            P = T @ P @ T.T + RR
        return out


def fit_arima(x, order=(0, 0, 1), seasonal=(0, 0, 0), period: int = 12, include_mean: bool = True,
              tol: float = 1e-10, polish: bool = True) -> ArimaFit:
    """Exact-likelihood ARMA fit (d = D = 0) with optional mean."""
    x = np.asarray(x, float)
    p, d, q = order
    P_, D_, Q_ = seasonal
    if d or D_:
        raise ValueError("differenced models are not part of the reference's fits")
    n = len(x)
    if not np.isfinite(x).all():
        raise ValueError("missing values")
    if n < 3:
        raise ValueError(f"{n} months are too few for a model")
    m0, sd = float(np.mean(x)), float(np.std(x))
    if sd <= 1e-12 * abs(m0) or sd == 0:
        raise ValueError("constant series")
    z = (x - m0) / sd
    npar = p + q + P_ + Q_ + (1 if include_mean else 0)

    def unpack(par):
        i = 0
        phi = par[i:i + p]; i += p
        theta = par[i:i + q]; i += q
        sphi = par[i:i + P_]; i += P_
        stheta = par[i:i + Q_]; i += Q_
        mu = par[i] if include_mean else 0.0
        return phi, theta, sphi, stheta, mu

    def objective(par):
        phi, theta, sphi, stheta, mu = unpack(par)
        fphi, ftheta = expand(phi, theta, sphi, stheta, period)
        if not _stationary(fphi) or not _stationary(-ftheta):
            return 1e10
        try:
            ssq, sumlog, *_ = kalman(z - mu, fphi, ftheta)
        except np.linalg.LinAlgError:
            return 1e10
        if not (ssq > 0 and math.isfinite(ssq) and math.isfinite(sumlog)):
            return 1e10
        return 0.5 * math.log(ssq / n) + 0.5 * sumlog / n

    x0 = np.zeros(npar)
    if npar:
        best, _ = nelder_mead(objective, x0, tol=tol)
        if polish:
            best, _ = nelder_mead(objective, best, step=0.01, tol=tol)
    else:
        best = x0
    phi, theta, sphi, stheta, mu = unpack(best)
    fphi, ftheta = expand(phi, theta, sphi, stheta, period)
    ssq, sumlog, v, F, a, P = kalman(z - mu, fphi, ftheta)
    s2 = ssq / n
    loglik = -0.5 * (n * math.log(2 * math.pi * s2 * sd * sd) + sumlog + n)
    resid = v / np.sqrt(F) * sd
    return ArimaFit(order, seasonal, period, best, m0 + mu * sd, s2 * sd * sd, loglik, n, resid,
                    a, P, fphi, ftheta, sd, npar)


def away_from_unit_roots(fit: ArimaFit, margin: float = 1.01) -> bool:
    """Whether all roots of both polynomials lie outside a circle slightly wider than the unit circle."""
    for lags in (np.r_[1.0, -np.asarray(fit.phi, float)], np.r_[1.0, np.asarray(fit.theta, float)]):
        lags = np.trim_zeros(lags, "b")
        if len(lags) > 1 and np.any(np.abs(np.roots(lags[::-1])) <= margin):
            return False
    return True


def sigma2_of(fit: ArimaFit, df_correction: bool = False) -> float:
    """σ² in data units: Σv²/F / n (``arima``), or / (n − npar) as the automatic search reports."""
    return fit.sigma2 * fit.n / (fit.n - fit.npar) if df_correction else fit.sigma2


def auto_arima(x, period: int = 12, max_p: int = 2, max_q: int = 2, seasonal: bool = True,
               include_mean: bool = True) -> ArimaFit:
    """Search (p, 0, q)(P, 0, Q)[s] by AICc (123), then refit the winner at full precision.

    Candidates: p ≤ max_p, q ≤ max_q; one seasonal AR or MA term when the
    series spans two full periods.  The search fits use a looser tolerance.
    """
    cands = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    seas = [(0, 0)]
    if seasonal and len(x) >= 2 * period:
        seas += [(1, 0), (0, 1)]
    best = None
    for (p, q) in cands:
        for (P_, Q_) in seas:
            if (P_ or Q_) and p + q > 2:
                continue
            try:
                f = fit_arima(x, (p, 0, q), (P_, 0, Q_), period, include_mean, tol=1e-7, polish=False)
            except (np.linalg.LinAlgError, ValueError):
                continue
            if away_from_unit_roots(f) and (best is None or f.aicc < best.aicc):
                best = f
    if best is None:
        raise ValueError("no candidate order has a model with its roots away from the unit circle")
    return fit_arima(x, best.order, best.seasonal, period, include_mean)
