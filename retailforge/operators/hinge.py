"""Hinge-basis regression and classification (MARS; operators 113-115).

Forward pass: every candidate pair parent·max(0, x−t), parent·max(0, t−x)
(knots t at approximate quantiles of each variable) is scored in ONE
distributed pass per step: each partition emits the sufficient statistics
CᵀB, CᵀC (2×2 per pair), CᵀY, BᵀB, BᵀY, YᵀY; the reduction is by array
position.  The residual-sum-of-squares drop of a pair follows from the Schur
complement on the driver.  Backward pass: terms are pruned by GCV using the
Gram matrix of the final basis (one more pass), no refits over the data.
Several responses (one-hot classes) share one basis, as the multi-response
forward pass does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.functions.calendar import argmax_label
from retailforge.operators.design import with_levels
from retailforge.session import stage

Term = tuple  # tuple of (var, knot, sign) factors; () is the intercept


def _eval_terms(pdf: pd.DataFrame, terms: list[Term]) -> np.ndarray:
    out = np.ones((len(pdf), len(terms)))
    for j, term in enumerate(terms):
        for var, knot, sign in term:
            x = pdf[var].to_numpy(float)
            out[:, j] *= np.maximum(sign * (x - knot), 0.0)
    return out


#: rows of candidate columns that are filled at once, so that they stay in the processor's cache
FILL_ROWS = 256


class Candidates:
    """Both hinge columns of every candidate (parent, variable, knot) for one batch of rows after another.

    The two matrices are kept between batches: new ones of that size would cost more than their values.
    """

    def __init__(self, xs: list[str], cands: list[tuple[int, str, float]]):
        self.parent = np.array([pi for pi, _, _ in cands], np.int64)
        self.var = np.array([xs.index(x) for _, x, _ in cands], np.int64)
        self.knot = np.array([t for _, _, t in cands], float)
        self.right = self.left = np.empty((0, len(cands)))

    def __call__(self, B: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``parent * max(0, x - t)`` and ``parent * max(0, t - x)``, valid until the next call."""
        n = len(B)
        if len(self.right) < n:
            self.right, self.left = np.empty((n, len(self.knot))), np.empty((n, len(self.knot)))
        right, left = self.right[:n], self.left[:n]
        for a in range(0, n, FILL_ROWS):
            g = slice(a, min(a + FILL_ROWS, n))
            parent, away = B[g][:, self.parent], X[g][:, self.var]
            away -= self.knot
            np.maximum(away, 0, out=right[g])
            right[g] *= parent
            np.negative(away, out=away)
            np.maximum(away, 0, out=left[g])
            left[g] *= parent
        return right, left


def term_column(term: Term) -> Column:
    e = F.lit(1.0)
    for var, knot, sign in term:
        e = e * F.greatest(F.lit(float(sign)) * (F.col(f"`{var}`") - F.lit(float(knot))), F.lit(0.0))
    return e


def term_label(term: Term) -> str:
    if not term:
        return "(Intercept)"
    return "*".join(f"h({v}-{k:.6g})" if s > 0 else f"h({k:.6g}-{v})" for v, k, s in term)


def _reduce(df: DataFrame, part, size: int) -> np.ndarray:
    red = (df.mapInPandas(part, "s array<double>").select(F.posexplode("s").alias("pos", "v"))
             .groupBy("pos").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in red:
        out[r["pos"]] = r["v"]
    return out


def _gram(df: DataFrame, terms: list[Term], ys: list[str]) -> np.ndarray:
    q = len(terms) + len(ys)

    def part(it):
        acc = np.zeros((q, q))
        for pdf in it:
            if len(pdf):
                z = np.column_stack([_eval_terms(pdf, terms)] + [pdf[y].to_numpy(float)[:, None] for y in ys])
                acc += z.T @ z
        yield pd.DataFrame({"s": [acc.ravel().tolist()]})
    return _reduce(df, part, q * q).reshape(q, q)


def knots_for(df: DataFrame, xs: list[str], n_knots: int = 10) -> dict[str, list[float]]:
    probs = [i / (n_knots + 1) for i in range(1, n_knots + 1)]
    row = df.select(*[F.percentile_approx(F.col(f"`{x}`"), probs, 10000).alias(x) for x in xs]).first()
    if not row[xs[0]]:
        return {x: [] for x in xs}
    # 0/1 columns have one hinge, at 0; the values below the largest are the only knots that both sides of can differ
    return {x: sorted({float(v) for v in row[x]} if len(set(row[x])) > 2 or set(row[x]) - {0, 1} else {0.0}) for x in xs}


def forward_pass(df: DataFrame, ys: list[str], xs: list[str], degree: int = 2, max_terms: int = 21,
                 n_knots: int = 10, thresh: float = 0.001):
    """Greedy hinge-pair additions until ``max_terms`` or the R² gain falls below ``thresh``."""
    knots = knots_for(df, xs, n_knots)
    terms: list[Term] = [()]
    G = _gram(df, terms, ys)
    tss = float(np.trace(G[1:, 1:]) - (G[0, 1:] @ G[0, 1:]) / G[0, 0])
    while len(terms) + 2 <= max_terms:
        cands = []
        for pi, parent in enumerate(terms):
            if len(parent) >= degree:
                continue
            used = {v for v, _, _ in parent}
            for x in xs:
                if x in used:
                    continue
                for t in knots[x]:
                    cands.append((pi, x, t))
        if not cands:
            break
        M, r, C = len(terms), len(ys), len(cands)
        size = C * M * 2 + C * 3 + C * r * 2 + M * M + M * r + r * r

        def part(it, terms=list(terms), cands=cands):
            acc, columns = np.zeros(size), Candidates(xs, cands)
            for pdf in it:
                if not len(pdf):
                    continue
                B = _eval_terms(pdf, terms)
                Y = np.column_stack([pdf[y].to_numpy(float) for y in ys])
                c1, c2 = columns(B, np.column_stack([pdf[x].to_numpy(float) for x in xs]))
                o = 0
                for block in (c1.T @ B, c2.T @ B):
                    acc[o:o + block.size] += block.ravel(); o += block.size
                for u, v in ((c1, c1), (c1, c2), (c2, c2)):
                    acc[o:o + C] += np.einsum("ij,ij->j", u, v); o += C
                for block in (c1.T @ Y, c2.T @ Y):
                    acc[o:o + block.size] += block.ravel(); o += block.size
                for block in (B.T @ B, B.T @ Y, Y.T @ Y):
                    acc[o:o + block.size] += block.ravel(); o += block.size
            yield pd.DataFrame({"s": [acc.tolist()]})
        s = _reduce(df, part, size)
        o = 0
        c1B = s[o:o + C * M].reshape(C, M); o += C * M
        c2B = s[o:o + C * M].reshape(C, M); o += C * M
        s11, s12, s22 = s[o:o + C], s[o + C:o + 2 * C], s[o + 2 * C:o + 3 * C]; o += 3 * C
        c1Y = s[o:o + C * r].reshape(C, r); o += C * r
        c2Y = s[o:o + C * r].reshape(C, r); o += C * r
        BB = s[o:o + M * M].reshape(M, M); o += M * M
        BY = s[o:o + M * r].reshape(M, r); o += M * r
        Ainv = np.linalg.pinv(BB)
        # Schur complements per candidate pair
        p1, p2 = c1B @ Ainv, c2B @ Ainv
        S11 = s11 - np.einsum("cm,cm->c", p1, c1B)
        S12 = s12 - np.einsum("cm,cm->c", p1, c2B)
        S22 = s22 - np.einsum("cm,cm->c", p2, c2B)
        u1 = c1Y - p1 @ BY
        u2 = c2Y - p2 @ BY
        det = S11 * S22 - S12 * S12
        ok = det > 1e-9 * np.maximum(S11 * S22, 1e-300)
        gain = np.where(ok, ((S22[:, None] * u1 * u1 - 2 * S12[:, None] * u1 * u2 + S11[:, None] * u2 * u2)
                             / np.where(ok, det, 1.0)[:, None]).sum(1), -np.inf)
        # single-hinge fallback when the pair is degenerate (one side empty)
        single = np.where(S11 > 1e-12, (u1 * u1).sum(1) / np.maximum(S11, 1e-300), -np.inf)
        best = int(np.argmax(np.maximum(gain, single)))
        g = max(gain[best], single[best])
        if not np.isfinite(g) or g / tss < thresh:
            break
        pi, x, t = cands[best]
        parent = terms[pi]
        terms.append(parent + ((x, t, 1),))
        if gain[best] >= single[best]:
            terms.append(parent + ((x, t, -1),))
    return terms


def _rss_subset(G: np.ndarray, idx: list[int], r: int) -> float:
    M = G.shape[0] - r
    A = G[np.ix_(idx, idx)]
    g = G[np.ix_(idx, list(range(M, M + r)))]
    yy = np.trace(G[M:, M:])
    sol = np.linalg.lstsq(A, g, rcond=None)[0]
    return float(yy - np.sum(g * sol))


def backward_pass(df: DataFrame, terms: list[Term], ys: list[str], degree: int = 2):
    """Prune by GCV; returns (kept terms, coefficients per response, path, n)."""
    r = len(ys)
    G = _gram(df, terms, ys)
    n = G[0, 0]
    penalty = 3.0 if degree > 1 else 2.0

    def gcv(rss, m):
        c = m + penalty * (m - 1) / 2
        return rss / n / (1 - c / n) ** 2 if c < n else np.inf
    cur = list(range(len(terms)))
    path = [(list(cur), _rss_subset(G, cur, r))]
    while len(cur) > 1:
        best = None
        for j in cur[1:]:
            sub = [i for i in cur if i != j]
            rss = _rss_subset(G, sub, r)
            if best is None or rss < best[0]:
                best = (rss, sub)
        cur = best[1]
        path.append((list(cur), best[0]))
    scored = [(gcv(rss, len(idx)), idx, rss) for idx, rss in path]
    best_gcv, kept, _ = min(scored, key=lambda z: z[0])
    M = G.shape[0] - r
    A = G[np.ix_(kept, kept)]
    coef = np.linalg.lstsq(A, G[np.ix_(kept, list(range(M, M + r)))], rcond=None)[0]
    return [terms[i] for i in kept], coef, [(idx, rss, gcv(rss, len(idx))) for idx, rss in path], n


def evimp(terms: list[Term], path, kept_size: int, xs: list[str]) -> list[tuple]:
    """Variable importance: subsets using a variable, summed GCV / RSS decreases scaled to 100 (115)."""
    used_in = {x: 0 for x in xs}
    dg = {x: 0.0 for x in xs}
    dr = {x: 0.0 for x in xs}
    subsets = [p for p in path if len(p[0]) <= kept_size]
    for idx, _, _ in subsets:
        vs = {v for i in idx for v, _, _ in terms[i]}
        for v in vs:
            used_in[v] += 1
    for (big, rss_b, gcv_b), (small, rss_s, gcv_s) in zip(path, path[1:]):
        if len(big) > kept_size:
            continue
        vs = {v for i in big for v, _, _ in terms[i]}  # every variable of the subset, not only of the removed term
        for v in vs:
            dg[v] += gcv_s - gcv_b
            dr[v] += rss_s - rss_b
    mg, mr = max(list(dg.values()) + [1e-300]), max(list(dr.values()) + [1e-300])
    final_vars = {v for i in path[[len(p[0]) for p in path].index(kept_size)][0] for v, _, _ in terms[i]}
    return [(x, int(x in final_vars), int(used_in[x]), float(100 * max(dg[x], 0) / mg),
             float(100 * max(dr[x], 0) / mr)) for x in xs]


def _factors(df: DataFrame, xs: list[str]) -> list[str]:
    types = dict(df.dtypes)
    return [x for x in xs if types[x] in ("string", "boolean")]


def _level_columns(df: DataFrame, terms: list[Term]) -> DataFrame:
    """The 0/1 columns that the terms use and ``df`` lacks; ``<column><level>`` names a text or boolean column."""
    texts = _factors(df, df.columns)
    for v in sorted({v for t in terms for v, _, _ in t if v not in df.columns}):
        f = next(c for c in sorted(texts, key=len, reverse=True) if v.startswith(c))
        df = df.withColumn(v, (F.col(f"`{f}`").cast("string") == F.lit(v[len(f):])).cast("double"))
    return df


def mars(df: DataFrame, y: str | list[str], xs: list[str], degree: int = 2, max_terms: int = 21,
         n_knots: int = 10):
    """Fit a hinge-basis model; returns (terms, coefficients, importance rows, n).

    Text and boolean predictors enter as 0/1 columns ``<column><level>``.
    """
    ys = [y] if isinstance(y, str) else list(y)
    d = stage(df.select(*ys, *xs).dropna(), "hinge-frame")
    factors = _factors(d, xs)
    d, names = with_levels(d, factors)
    xs = [x for x in xs if x not in factors] + names
    terms = forward_pass(d, ys, xs, degree, max_terms, n_knots)
    all_terms = list(terms)
    kept, coef, path, n = backward_pass(d, all_terms, ys, degree)
    imp = evimp(all_terms, path, len(kept), xs)
    return kept, coef, imp, n


def mars_predict(df: DataFrame, terms: list[Term], coef: np.ndarray, name: str = "fitted") -> DataFrame:
    e = F.lit(0.0)
    for t, c in zip(terms, coef[:, 0]):
        e = e + term_column(t) * F.lit(float(c))
    return _level_columns(df, terms).select(*[F.col(f"`{c}`") for c in df.columns], e.alias(name))


def mars_classifier(train: DataFrame, label: str, xs: list[str], degree: int = 2, max_terms: int = 21,
                    n_knots: int = 10, max_iter: int = 50):
    """Shared hinge basis on one-hot class responses, one logistic fit per class (114).

    Returns a function scoring a frame with the class probabilities and the
    strict-argmax label ('NA' on ties, 83).
    """
    classes = sorted(r[0] for r in train.select(label).distinct().collect())
    ind = train.select("*", *[(F.col(label) == F.lit(c)).cast("double").alias(f"__cls{i}")
                              for i, c in enumerate(classes)])
    kept, _, imp, _ = mars(ind, [f"__cls{i}" for i in range(len(classes))], xs, degree, max_terms, n_knots)
    basis_cols = [term_column(t).alias(f"__b{j}") for j, t in enumerate(kept) if t]
    names = [f"__b{j}" for j, t in enumerate(kept) if t]

    if not names:  # no hinge improved the fit: intercept-only model, class priors
        priors = {r[0]: r[1] for r in train.groupBy(label).count().collect()}

        def score0(df: DataFrame, name: str = "predicted") -> DataFrame:
            tot = float(sum(priors.values()))
            out = df.select("*", *[F.lit(priors[c] / tot).alias(f"prob_{c}") for c in classes])
            return out.withColumn(name, argmax_label({c: f"prob_{c}" for c in classes}))
        return score0, kept, imp

    def basis(df):
        wide = _level_columns(df, kept)
        return VectorAssembler(inputCols=names, outputCol="__bx").transform(wide.select(*[F.col(f"`{c}`") for c in df.columns], *basis_cols))
    btrain = stage(basis(ind).select("__bx", *[f"__cls{i}" for i in range(len(classes))]), "hinge-basis")
    models = [LogisticRegression(labelCol=f"__cls{i}", featuresCol="__bx", family="binomial", regParam=0.0,
                                 maxIter=max_iter, probabilityCol=f"__p{i}", rawPredictionCol=f"__r{i}",
                                 predictionCol=f"__y{i}").fit(btrain) for i in range(len(classes))]

    def score(df: DataFrame, name: str = "predicted") -> DataFrame:
        out = basis(df)
        for i, m in enumerate(models):
            out = m.transform(out).withColumn(f"prob_{classes[i]}", vector_to_array(f"__p{i}")[1]) \
                   .drop(f"__p{i}", f"__r{i}", f"__y{i}")
        lab = argmax_label({c: f"prob_{c}" for c in classes})
        return out.withColumn(name, lab).drop("__bx", *names)
    return score, kept, imp
